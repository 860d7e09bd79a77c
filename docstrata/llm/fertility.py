"""Quality rules with tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated word windows.
The method measures how public vocabularies cut the words of a text: for each
vocabulary the characters per token, the share of tokens that stand for bare
bytes (byte fallback, or a part of a character) and the entropy of the text's
tokens as a share of the greatest entropy that so many tokens can have. A
document is rejected if a measure lies outside the band of its language (of
its script, where the language is null) at its length.

Bands are fences around the quartiles, ``FENCE`` times the spread and at least
``FENCE`` times a least spread, over all documents that pass the base rules. A
class of a language and a length (power of two of its tokens) of fewer than
``MIN_DOCS`` documents takes the band of the language, a smaller language that
of the table.

A word is cut as in running text, after a blank; white space has no tokens, and
a word beyond ``LONG_WORD`` code points is cut in slices of that. So the tokens
of a text are those of its words, and a worker asks a vocabulary only for words
that it has not met (a bounded memo with the words themselves as keys).

Scale. Texts are read once and stay in their task; the measures, one slim row a
document, are written. Quartiles come from counts by (language, length, bin),
which are partial aggregates; their number is bounded by bins, not rows.

Edge rows: null, empty and word-less texts have no words and fail the base
rules, and their measures are null; a null id stays null; rows that repeat are
judged alike, each on its own; an empty table gives an empty result; only
doc_id, text and lang are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import WS_CHARS, string_bytes, text_pieces, written

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
LONG_WORD = 1 << 14
#: Words of a worker's memo; it is emptied between texts, never inside one.
MEMO = 1 << 18
BLOCK = 1 << 20
MIN_DOCS = 100
#: Parts over which the documents of a class are dealt out to meet its bands.
SALTS = 64
FENCE = 3.0


@dataclass(frozen=True)
class Measure:
    """A measure, the width of its histogram bins and its least spread."""

    name: str
    bin: float
    spread: float


MEASURES = (Measure("chars_per_token", 0.005, 0.12), Measure("byte_share", 0.0005, 0.02), Measure("evenness", 0.001, 0.05))

#: First code points of letter ranges and their scripts.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_SCRIPT_AT = np.array([a for a, _ in SCRIPTS])
_SCRIPT_NAMES = [s for _, s in SCRIPTS]


# --------------------------------------------------------------------------
# Vocabularies


class Pieces:
    """A SentencePiece file: bare bytes are its byte-fallback tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bare = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)  # puts the blank before each itself


class Ranks:
    """A file of byte-level BPE ranks: bare bytes are tokens that are no whole characters."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bare = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.bare[i] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + w) for w in words]


KINDS = {".model": Pieces, ".tiktoken": Ranks}


def vocabulary(name: str) -> Pieces | Ranks:
    """A public vocabulary by its name there, or by its path."""
    return KINDS[name[name.rindex("."):]](name if "/" in name else public_tokenizers.path(name))


class Grown:
    """An array that doubles as it is appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(max(len(values), self.n), self.data.dtype)))
        self.data[self.n: self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


class Words(dict):
    """Numbers of words (bytes), counted from 0, and what the vocabularies make of them."""

    def __init__(self, vocabularies):
        super().__init__()
        self.vocabularies = vocabularies
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[bytes] = []
        self.chars = Grown(np.int64)
        self.ends = [Grown(np.int64) for _ in self.vocabularies]
        self.tokens = [Grown(np.int64) for _ in self.vocabularies]

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def learn(self) -> None:
        if not self.new:
            return
        words = [w.decode() for w in self.new]
        self.new = []
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.chars.extend(lens)
        slices = words
        if lens.max() > LONG_WORD:
            slices = [w[k: k + LONG_WORD] for w in words for k in range(0, len(w), LONG_WORD)]
        last = np.cumsum(-(-lens // LONG_WORD)) - 1
        for v, ends, tokens in zip(self.vocabularies, self.ends, self.tokens):
            got = v.encode(slices)
            total = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))[last]
            ends.extend(total + tokens.n)
            tokens.extend(np.fromiter((i for g in got for i in g), np.int64, int(total[-1])))


# --------------------------------------------------------------------------
# Measures of a batch

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(text: bytes, words: Words, block: int = BLOCK) -> np.ndarray:
    """Numbers of the words of a text; long texts are cut at white space, so that only numbers are held."""
    if len(text) <= block:
        found = text.split()  # bytes: splits at the six white space bytes only
        return np.fromiter(map(words.__getitem__, found), np.int64, len(found))
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + block)
        end = gap.start() if gap else len(text)
        parts.append(word_numbers(text[at:end], words, end - at))
        at = end
    return np.concatenate(parts)


def repeated_words(number: np.ndarray, row: np.ndarray, n_rows: int, limit: int = 1 << 21) -> np.ndarray:
    """Words of each row in windows of three words that the row has twice or more."""
    if len(number) < 3:
        return np.zeros(n_rows, np.int64)
    base = int(number.max()) + 1
    pair = number[:-1] * base + number[1:]
    if base >= limit:  # three numbers don't fit in 63 bits
        _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1] * base + number[2:]
    at = np.flatnonzero(row[:-2] == row[2:])
    key, of = key[at], row[at]
    order = np.lexsort((key, of))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(number), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(row[covered], minlength=n_rows)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WS_CHARS)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters; Latin for texts of ASCII, Other for texts without letters beyond it."""
    if text.isascii():
        return "Latin"
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cp = cp[(cp >= 0x80) & (cp != 0xD7) & (cp != 0xF7) | (cp >= 65) & (cp <= 90) | (cp >= 97) & (cp <= 122)]
    if not len(cp):
        return "Other"
    counts = np.bincount(np.searchsorted(_SCRIPT_AT, cp, side="right") - 1, minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for name, n in zip(_SCRIPT_NAMES, counts.tolist()):
        total[name] = total.get(name, 0) + n
    return max(total, key=total.get)


def token_measures(words: Words, number: np.ndarray, row: np.ndarray, n_rows: int) -> list[tuple[np.ndarray, ...]]:
    """By vocabulary: tokens, characters per token, bare share and evenness of each row (NaN without tokens)."""
    key = np.sort(row * (len(words) + 1) + number)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    of, word = np.divmod(key[first], len(words) + 1)
    chars = np.bincount(of, weights=times * words.chars.view()[word], minlength=n_rows)
    out = []
    for v, ends, tokens in zip(words.vocabularies, words.ends, words.tokens):
        ends = ends.view()
        lens = ends[word] - np.where(word > 0, ends[word - 1], 0)
        starts = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) + np.repeat(ends[word] - lens - starts, lens)
        token, own, n = tokens.view()[at], np.repeat(of, lens), np.repeat(times, lens)
        total = np.bincount(own, weights=n, minlength=n_rows)
        bare = np.bincount(own, weights=n * v.bare[token], minlength=n_rows)
        place = own * len(v.bare) + token
        order = np.argsort(place, kind="stable")
        place, n = place[order], n[order]
        cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
        count = np.add.reduceat(n, cut) if len(cut) else np.zeros(0)
        doc = place[cut] // len(v.bare)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = count / total[doc]
            entropy = np.bincount(doc, weights=-share * np.log2(share), minlength=n_rows)
            even = np.where(total > 1, entropy / np.log2(total), 0.0)
            out.append((total.astype(np.int64), chars / total, bare / total, np.where(total > 0, even, np.nan)))
    return out


_memo: dict[tuple[str, ...], Words] = {}


def _measure_rows(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names not in _memo:
            _memo[names] = Words([vocabulary(n) for n in names])
        words = _memo[names]
        for batch in batches:
            for b in text_pieces(batch, limit=BLOCK):
                if len(words) > MEMO:
                    words.clear()
                texts = b.column("text").to_pylist()
                numbers = [word_numbers(t.encode(), words) for t in texts]
                words.learn()
                n = len(texts)
                sizes = np.array([len(x) for x in numbers], np.int64)
                number = np.concatenate(numbers)
                row = np.repeat(np.arange(n), sizes)
                data, offs = string_bytes(b.column("text"))
                symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
                chars = np.bincount(row, weights=words.chars.view()[number], minlength=n).astype(np.int64)
                langs = b.column("lang").to_pylist()
                groups = [f"script {script(t)}" if g is None else f"lang {g}" for g, t in zip(langs, texts)]
                cols = [b.column("doc_id"), pa.array(sizes), pa.array(chars), pa.array(symbols[offs[1:]] - symbols[offs[:-1]], pa.int64()),
                        pa.array([repeated_lines(t) for t in texts], pa.int64()), pa.array(repeated_words(number, row, n), pa.int64()),
                        pa.array(groups)]
                for total, *values in token_measures(words, number, row, n):
                    cols += [pa.array(total), *[pa.array(x, pa.float64(), mask=np.isnan(x)) for x in values]]
                yield pa.RecordBatch.from_arrays(cols, names=_columns(names))

    return run


def _columns(names: tuple[str, ...]) -> list[str]:
    own = [f"{c}_{k + 1}" for k in range(len(names)) for c in ("tokens", *[m.name for m in MEASURES])]
    return ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "grp", *own]


def measured(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """The base counts and the measures of every row, written: no text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    double = {m.name for m in MEASURES}
    kinds = ["string" if c == "grp" else "double" if c.rsplit("_", 1)[0] in double else "long" for c in _columns(vocabularies)]
    schema = ", ".join(f"{c} {k}" for c, k in zip(_columns(vocabularies), kinds))
    return written(rows.mapInArrow(_measure_rows(vocabularies), schema), "fertility")


# --------------------------------------------------------------------------
# Bands


def bands(rows: DataFrame, vocabularies: int, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """(grp, size_class, bands): bands is an array of (low, high) in the order of
    the measure columns, for every class that rows has; rows as ``judged_rows`` gives them."""
    values = [(m, f"{m.name}_{k + 1}") for k in range(vocabularies) for m in MEASURES]
    each = F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(c) / m.bin).cast("long").alias("bin")) for i, (m, c) in enumerate(values)])
    fit = rows.where("NOT base_failed").select("grp", "size_class", F.inline(each)).where("bin IS NOT NULL")
    counts = written(fit.groupBy("grp", "size_class", "m", "bin").agg(F.count(F.lit(1)).alias("n")), "fertility-counts")

    def fences(*keys: str) -> DataFrame:
        quartiles = counts.groupBy(*keys, "m").agg(F.sum("n").alias("docs"), F.expr("percentile(bin, array(0.25D, 0.75D), n)").alias("q"))
        width = F.element_at(F.array(*[F.lit(m.bin) for m, _ in values]), F.col("m") + 1)
        least = F.element_at(F.array(*[F.lit(m.spread) for m, _ in values]), F.col("m") + 1)
        low, high = F.col("q")[0] * width, F.col("q")[1] * width
        room = F.greatest(high - low, least) * fence
        band = F.struct("m", (low - room).alias("low"), (high + room).alias("high"))
        return quartiles.groupBy(*keys).agg(F.max("docs").alias("docs"), F.array_sort(F.collect_list(band)).alias("b"))

    # the bands of classes, languages and the table in one list; a class asks for its three
    own = fences("grp", "size_class").where(F.col("docs") >= min_docs).select(F.lit(2).alias("level"), "grp", "size_class", "b")
    by_lang = fences("grp").where(F.col("docs") >= min_docs).select(F.lit(1).alias("level"), "grp", F.lit(-1).alias("size_class"), "b")
    everything = fences().select(F.lit(0).alias("level"), F.lit("").alias("grp"), F.lit(-1).alias("size_class"), "b")
    known = own.unionByName(by_lang).unionByName(everything).select(
        "level", F.col("grp").alias("g"), F.col("size_class").alias("s"), "b")
    asked = F.array(F.struct(F.lit(2).alias("l"), F.col("grp").alias("ag"), F.col("size_class").alias("as")),
                    F.struct(F.lit(1).alias("l"), F.col("grp").alias("ag"), F.lit(-1).alias("as")),
                    F.struct(F.lit(0).alias("l"), F.lit("").alias("ag"), F.lit(-1).alias("as")))
    classes = counts.select("grp", "size_class").distinct().select("grp", "size_class", F.explode(asked).alias("a"))
    found = classes.join(known, (F.col("a.l") == F.col("level")) & (F.col("a.ag") == F.col("g")) & (F.col("a.as") == F.col("s")))
    return found.groupBy("grp", "size_class").agg(F.max_by("b", "level").alias("bands"))


def judged_rows(rows: DataFrame) -> DataFrame:
    """The measures with the verdict of the base rules and the class of the length."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn(
        "size_class", F.when(F.col("tokens_1") > 0, F.floor(F.log2(F.col("tokens_1").cast("double")))).otherwise(0).cast("int"))


def quality(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, min_docs: int = MIN_DOCS, fence: float = FENCE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the measures and ``outside`` (measures beyond their band) of every row."""
    rows = judged_rows(measured(docs, vocabularies))
    limits = bands(rows, len(vocabularies), min_docs, fence).withColumnRenamed("grp", "g").withColumnRenamed("size_class", "s")
    # few rows, one for each salt, so that the documents of a common class are dealt out
    limits = limits.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int"))
    names = [f"{m.name}_{k + 1}" for k in range(len(vocabularies)) for m in MEASURES]
    out = rows.join(limits, (F.col("grp") == F.col("g")) & (F.col("size_class") == F.col("s")) & (F.col("salt") == F.col("t")), "left")
    beyond = [F.when((F.col(c) < F.col("bands")[i]["low"]) | (F.col(c) > F.col("bands")[i]["high"]), F.lit(c)) for i, c in enumerate(names)]
    out = out.withColumn("outside", F.array_compact(F.array(*beyond)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), "outside", "grp", "size_class", *names)


def accepted(docs: DataFrame, **options) -> DataFrame:
    """doc_id of the rows that are kept."""
    return quality(docs, **options).where("kept").select("doc_id")
