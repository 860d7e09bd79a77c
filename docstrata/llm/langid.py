"""Language identification by interpolated Kneser-Ney character models.

Words are runs of letters of the lower-cased text, each with a start and an
end mark; a model gives the probability of a character after up to
``ORDER - 1`` characters of its word. Gram counts come from all learning
rows (map-side counts of distinct words, then ``groupBy``); continuation
counts, discounts and the languages' gram tables are aggregations of them.
Probabilities are joins over them, one order after the other: a gram with the
sums of its context and with the probability of its suffix. The fitted model
is sorted arrays of 64-bit hashes of grams and contexts with one column of log
probabilities or back-off weights per language; texts are scored by vectorised
binary search, each distinct word of a block once.

The language of lowest cross-entropy per character wins (ties: smallest
name). Rejection is calibrated on the learning rows: per language the mean
cross-entropy and its variance at a length; a text whose cross-entropy lies
more than ``MAX_Z`` standard errors, and ``MIN_EXCESS``, above the mean is
rejected, and one without letters.

Scale. The models are fitted on ``LEARN_ROWS`` labelled rows of a language at
most (a hash sample; all rows where there are fewer), and every gram type of
those is in them, whatever its count. So the size of the model is bounded by the
parameter, not by the corpus; the driver puts its arrays together and broadcasts
them. The rejection limits come from the same rows. All rows are scored, in
slices of bounded size. Driver rows besides: one per order and language.

Edge rows: null text, or text without letters, is ``und`` with score 0; a
null language is not learned from; rows with a null id count as held out;
without any learning row everything is ``und``; rows that repeat are judged
alike; an empty table gives an empty result. Words of over ``BLOCK``
characters are cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import U64, mix, prefix_sums, range_hash, release, written

ORDER = 5
#: Labelled rows of a language that the models learn from.
LEARN_ROWS = 20_000
MAX_Z = 8.0
#: Nats per character that a rejected text lies above its language's mean at least.
MIN_EXCESS = 0.75
BLOCK = 1 << 18
#: Marks of a word's start and end; no letter is one of them.
START, END = "^", "$"
_B = U64(0x9E3779B97F4A7C15)
_TOP = U64(1 << 63)
UNKNOWN = "und"
#: Rows that are scored at a time.
SCORED_ROWS = 1024

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """By code point: a letter (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _slices(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """(row, lower-cased text) in blocks of about BLOCK characters; long texts are cut between words."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text.as_py() or "").lower()
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            if end < len(text):
                back = end
                while back > at and text[back - 1].isalpha():
                    back -= 1
                end = back if back > at else end
            rows.append(i)
            parts.append(text[at:end])
            size += end - at
            at = end
            if size >= BLOCK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def distinct_words(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends) of the distinct words, which of them each word is, and each word's row."""
    cp = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = np.concatenate(([False], is_letter()[cp], [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(p) + 1 for p in parts])
    row = np.asarray(rows, np.int64)[np.searchsorted(bounds, starts, side="right")] if len(starts) else np.zeros(0, np.int64)
    keys = range_hash(prefix_sums(mix(cp.astype(U64) + U64(1))), starts, ends)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return cp, starts[first], ends[first], which, row


def events(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked words one after the other: symbols, word of each, place in its word (0: the start mark)."""
    lens = ends - starts + 2
    total = np.concatenate(([0], np.cumsum(lens)))
    word = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(total[-1]) - total[:-1][word]
    at = starts[word] + place - 1
    symbols = cp[np.clip(at, 0, max(len(cp) - 1, 0))] if len(cp) else np.zeros(0, np.int64)
    symbols = np.where(place == 0, ord(START), np.where(place == lens[word] - 1, ord(END), symbols))
    return symbols, word, place


def gram_keys(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """By order 1..: hash of the gram that ends at each symbol (meaningless where the word is shorter)."""
    s = mix(symbols.astype(U64) + U64(7))
    out, h = [], np.zeros(len(s), U64)
    for k in range(order):
        back = np.concatenate((np.zeros(min(k, len(s)), U64), s[: max(0, len(s) - k)]))
        h = h * _B + back
        out.append(mix(h + U64(k + 1)))
    return out


def gram_key(gram: str) -> int:
    return int(gram_keys(np.array([ord(c) for c in gram], np.int64), len(gram))[-1][-1])


# --------------------------------------------------------------------------
# Counts


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.asarray(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                grams: dict[str, int] = {}
                for rows, parts in _slices(b.column("text").filter(pa.array(langs == lang))):
                    cp, starts, ends, which, _ = distinct_words(rows, parts)
                    n = np.bincount(which, minlength=len(starts))
                    symbols, word, place = events(cp, starts, ends)
                    keys = gram_keys(symbols, order)
                    size = np.minimum(place + 1, order)
                    real = place > 0  # the start mark is no event
                    key = np.select([size == k + 1 for k in range(order)], keys)[real]
                    end, size, weight = np.flatnonzero(real), size[real], n[word[real]]
                    _, first, gram = np.unique(key, return_index=True, return_inverse=True)
                    counts = np.bincount(gram, weights=weight, minlength=len(first)).astype(np.int64)
                    for i, c in zip(first.tolist(), counts.tolist()):
                        g = "".join(map(chr, symbols[end[i] + 1 - size[i]: end[i] + 1].tolist()))
                        grams[g] = grams.get(g, 0) + c
                if grams:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())],
                        names=["lang", "gram", "n"])
            release()

    return run


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of the longest grams, those of a word's first characters among them."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _count_grams(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def all_orders(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of every order: counts where a gram can't be longer, else continuation counts."""
    level = counts.where(F.length("gram") == order)
    out = level
    for k in range(order - 1, 0, -1):
        inner = level.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        level = inner.unionByName(counts.where(F.length("gram") == k))
        out = out.unionByName(level)
    return out


# --------------------------------------------------------------------------
# Model


@dataclass
class Model:
    """Sorted gram hashes with log probabilities, context hashes with log back-off weights, by language."""

    langs: list[str]
    order: int
    floor: np.ndarray
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return at, keys[at] == want

    def log_probs(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of each event (place > 0) in each language."""
        keys = gram_keys(symbols, self.order)
        out = np.zeros((len(symbols), len(self.langs)))
        todo = np.flatnonzero(place > 0)
        for k in range(self.order, 0, -1):
            able = place[todo] + 1 >= k
            ask = todo[able]
            at, hit = self._find(self.grams, keys[k - 1][ask])
            out[ask[hit]] += self.logp[at[hit]]
            miss = ask[~hit]
            if k > 1:
                at, seen = self._find(self.contexts, keys[k - 2][miss - 1])
                out[miss[seen]] += self.backoff[at[seen]]
                todo = np.concatenate((todo[~able], miss))
            else:
                out[miss] += self.floor
        return out


def _row_keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of grams of one length (a row each), as gram_keys has them."""
    h = np.zeros(len(codes), U64)
    s = mix(codes.astype(U64) + U64(7))
    for j in range(codes.shape[1] - 1, -1, -1):
        h = h * _B + s[:, j]
    return mix(h + U64(codes.shape[1]))


def _codes(grams: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, k).astype(np.int64)


def _ordered(keys: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed numbers of the same order (and back)."""
    return pa.array((keys ^ _TOP).view(np.int64))


def _matrix(b: pa.RecordBatch, col: str) -> np.ndarray:
    return np.asarray(b.column(col).flatten(), np.float64).reshape(b.num_rows, -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _weights(k: int, discount: np.ndarray):
    """Contexts of grams of k characters: hash and back-off weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, types = _matrix(b, "total"), _matrix(b, "types")
            # a language that never saw the context leaves all to the shorter one
            weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            keys = _row_keys(_codes(b.column("context"), k - 1)) if k > 1 else np.zeros(b.num_rows, U64)
            yield pa.RecordBatch.from_arrays([b.column("context"), b.column("total"), _ordered(keys), _lists(weight)],
                                             names=["context", "total", "key", "p"])

    return run


def _probabilities(k: int, discount: np.ndarray):
    """Grams of k characters: hash and probabilities, from counts, context and suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total, weight, lower = (_matrix(b, c) for c in ("n", "total", "weight", "lower"))
            p = np.where(total > 0, np.maximum(n - discount, 0) / np.maximum(total, 1), 0.0) + weight * lower
            yield pa.RecordBatch.from_arrays([b.column("gram"), _ordered(_row_keys(_codes(b.column("gram"), k))), _lists(p)],
                                             names=["gram", "key", "p"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.asarray(b.column("key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(keys.view(U64) ^ _TOP).tobytes()], pa.binary()), pa.array([np.log(_matrix(b, "p")).astype(np.float32).tobytes()], pa.binary())],
                names=["keys", "logs"])


def _sorted_arrays(rows: DataFrame | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, p) as hashes in order and their logarithms; as many as the learning rows have grams."""
    got = rows.mapInArrow(_packed, "keys binary, logs binary").collect() if rows is not None else []
    keys = np.frombuffer(b"".join(r["keys"] for r in got), U64)
    logs = np.frombuffer(b"".join(r["logs"] for r in got), np.float32).reshape(len(keys), width)
    order = np.argsort(keys)
    return keys[order], logs[order]


def fit(counts: DataFrame, order: int = ORDER) -> Model:
    """The model from rows (lang, gram, n) of all orders, each pair of lang and gram once."""
    size = F.length("gram")
    kinds = counts.groupBy(size.alias("k"), "lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
    langs = sorted({r["lang"] for r in kinds})
    width = len(langs)
    if not langs:
        none = np.zeros((0, 0), np.float32)
        return Model(langs, order, np.zeros(0), np.zeros(0, U64), none, np.zeros(0, U64), none)
    discount = np.full((order + 1, width), 0.1)
    for r in kinds:
        discount[r["k"], langs.index(r["lang"])] = np.clip(r["ones"] / max(r["ones"] + 2 * r["twos"], 1), 0.1, 0.95)

    def by_lang(value: F.Column) -> F.Column:
        return F.array(*[F.sum(F.when(F.col("lang") == x, value).otherwise(0)).cast("double") for x in langs])

    wide = written(counts.groupBy("gram").agg(by_lang(F.col("n")).alias("n")), "lang-wide")
    before = F.expr("substring(gram, 1, length(gram) - 1)")
    sums = written(counts.groupBy(size.alias("k"), before.alias("context")).agg(
        by_lang(F.col("n")).alias("total"), by_lang(F.lit(1)).alias("types")), "lang-contexts")
    symbols = wide.where(size == 1).count()
    level, grams, contexts = None, None, None
    for k in range(1, order + 1):
        context = sums.where(F.col("k") == k).select("context", "total", "types").mapInArrow(
            _weights(k, discount[k]), "context string, total array<double>, key long, p array<double>")
        if k == 1:  # one context; the floor is one character more, for those never seen
            floor = np.log(np.array(context.first()["p"]) / (symbols + 1))
        else:
            contexts = context.select("key", "p") if contexts is None else contexts.unionByName(context.select("key", "p"))
        rows = wide.where(size == k).join(context.select("context", "total", F.col("p").alias("weight")), F.substring("gram", 1, k - 1) == F.col("context"))
        if k == 1:
            rows = rows.withColumn("lower", F.array_repeat(F.lit(1.0 / (symbols + 1)), width))
        else:  # the suffix of a gram is a gram
            rows = rows.join(level.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), F.substring("gram", 2, k - 1) == F.col("suffix"))
        level = written(rows.select("gram", "n", "total", "weight", "lower").mapInArrow(
            _probabilities(k, discount[k]), "gram string, key long, p array<double>"), "lang-level")
        grams = level.select("key", "p") if grams is None else grams.unionByName(level.select("key", "p"))
    return Model(langs, order, floor, *_sorted_arrays(grams, width), *_sorted_arrays(contexts, width))


def learning_rows(docs: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """The labelled rows that are learned from: ``rows`` of a language or a few more, by a
    hash of their id, so that it is the same on any partitioning."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull())
    counts = labelled.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()  # one row a language
    many = {r["lang"]: rows / r["count"] for r in counts if r["count"] > rows}
    share = F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id").cast("long")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.lit(True)
    for lang, rate in sorted(many.items()):
        chosen = F.when(F.col("lang").cast("string") == lang, share < rate).otherwise(chosen)
    return labelled.where(chosen)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the learning rows of docs (doc_id, text, lang)."""
    counts = written(gram_counts(learning_rows(docs), order), "lang-counts")
    return fit(written(all_orders(counts, order), "lang-grams"), order)


# --------------------------------------------------------------------------
# Scoring


def losses_of(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(losses by language, characters) of each text."""
    k = len(m.langs)
    loss, n = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    for rows, parts in _slices(texts):
        cp, starts, ends, which, row = distinct_words(rows, parts)
        if not len(row):
            continue
        symbols, word, place = events(cp, starts, ends)
        logs = m.log_probs(symbols, place)
        per_word = np.stack([np.bincount(word, weights=logs[:, j], minlength=len(starts)) for j in range(k)], axis=1) if k else np.zeros((len(starts), 0))
        size = (ends - starts + 1)[which]
        lo, hi = int(row.min()), int(row.max()) + 1
        for j in range(k):
            loss[lo:hi, j] -= np.bincount(row - lo, weights=per_word[which, j], minlength=hi - lo)
        n[lo:hi] += np.bincount(row - lo, weights=size, minlength=hi - lo).astype(np.int64)
    return loss, n


def _scorer(m: Model):
    @F.arrow_udf("struct<loss:array<double>,n:long>")
    def score(texts: pa.Array) -> pa.Array:
        loss, n = losses_of(m, texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(m.langs), pa.int32()), pa.array(loss.ravel(), pa.float64()))
        release()
        return pa.StructArray.from_arrays([lists, pa.array(n)], names=["loss", "n"])

    return score


@dataclass
class Judge:
    """Columns of the decision from a row's losses; limits: (mean, variance at a length) by language."""

    langs: list[str]
    limits: dict[str, tuple[float, float]]
    max_z: float = MAX_Z
    min_excess: float = MIN_EXCESS

    def rejected(self, loss: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The verdict of ``columns`` on arrays."""
        out = (n == 0) | (loss.shape[1] == 0)
        if loss.shape[1]:
            best = loss.argmin(1)
            mean = loss[np.arange(len(n)), best] / np.maximum(n, 1)
            for lang, (center, var) in self.limits.items():
                over = mean - center
                far = (over * np.sqrt(n / max(var, 1e-9)) > self.max_z) & (over > self.min_excess)
                out |= far & (best == self.langs.index(lang))
        return out

    def columns(self, s: F.Column) -> dict[str, F.Column]:
        names = F.array(*[F.lit(x) for x in self.langs]) if self.langs else F.lit(None).cast("array<string>")
        losses, n = s["loss"], s["n"]
        best = F.array_min(losses)
        known = (n > 0) & (F.size(losses) > 0)
        pred = F.when(known, F.element_at(names, F.array_position(losses, best).cast("int"))).otherwise(UNKNOWN)
        loss = F.when(known, best / n)
        # posterior of the best at a bounded number of characters, so that long texts don't all round to 1
        scale = F.least(n, F.lit(60)) / n
        posterior = 1.0 / F.aggregate(losses, F.lit(0.0), lambda a, x: a + F.exp((best - x) * scale))
        odd = F.lit(False)
        for lang, (mean, var) in self.limits.items():
            over = loss - F.lit(mean)
            far = (over * F.sqrt(n / F.lit(max(var, 1e-9))) > self.max_z) & (over > self.min_excess)
            odd = F.when(pred == lang, far).otherwise(odd)
        return {"lang_pred": pred, "score": F.when(known, F.least(posterior, F.lit(1.0))).otherwise(0.0), "loss": loss,
                "rejected": (pred == UNKNOWN) | odd}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, held_out and the losses ``s`` of every row, written: no text."""
    score = _scorer(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       held_out().alias("held_out"), score(F.col("text").cast("string")).alias("s"))
    return written(rows, "lang-scored")


def calibrated(rows: DataFrame, model: Model, max_z: float = MAX_Z, min_excess: float = MIN_EXCESS) -> Judge:
    """The decision with its limits, from the scored learning rows that the models get right."""
    first = Judge(model.langs, {}).columns(F.col("s"))
    right = rows.where(F.col("lang") == first["lang_pred"]).select("lang", first["loss"].alias("loss"), F.col("s.n").alias("n"))
    mean = right.groupBy("lang").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean")).collect()
    means = {r["lang"]: r["mean"] for r in mean}  # one row a language of the model
    center = F.lit(None).cast("double")
    for lang, m in means.items():
        center = F.when(F.col("lang") == lang, F.lit(m)).otherwise(center)
    var = right.groupBy("lang").agg(F.avg((F.col("loss") - center) ** 2 * F.col("n")).alias("var")).collect()
    return Judge(model.langs, {r["lang"]: (means[r["lang"]], r["var"]) for r in var}, max_z, min_excess)


def fitted(docs: DataFrame, model: Model | None = None) -> tuple[Model, Judge]:
    """The models and the decision, both from the learning rows of docs."""
    model = model or train(docs)
    return model, calibrated(scored(learning_rows(docs), model), model)


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, loss, rejected of every row."""
    model, judge = fitted(docs, model)
    return scored(docs, model).select("doc_id", "held_out", *[c.alias(k) for k, c in judge.columns(F.col("s")).items()])


def _kept(m: Model, judge: Judge, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                b = batch.slice(at, SCORED_ROWS)
                keep = ~judge.rejected(*losses_of(m, b.column(text)))
                yield b.filter(pa.array(keep))
            release()

    return run


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that are not rejected, with their columns: one pass, no copy of a
    text is written or shuffled."""
    model, judge = fitted(docs, model)
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of the table may clash or hold dots
    rows = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    if dict(rows.dtypes)[text] != "string":
        rows, text = rows.withColumn("text", F.col(text).cast("string")), "text"
    return rows.mapInArrow(_kept(model, judge, text), rows.schema).select(*names).toDF(*docs.columns)
