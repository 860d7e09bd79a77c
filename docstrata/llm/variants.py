"""Spelling variants by a dictionary of trie-node pairs.

All words are put in a trie and, reversed, in a second one, whose nodes are
numbered. A word of n letters is written as pairs (node of a prefix, node of a
suffix): with one letter skipped between them, and with none. Two words differ
in one replaced letter if they share a pair with a skipped letter; a word with
an inserted letter shares its skipping pair with the whole word's pair of
adjoining nodes. So equal integer pairs are exactly the neighbours: no word is
compared with another. Of a run of equal letters only the first is skipped for
insertions, so that a link counts once.

Numbers. Words are range-sorted, and a task walks its sorted words with the path
of the last one: what a word shares with the word before keeps its nodes, the
rest gets new ones. Where a range begins inside a path, the first word's nodes
are named as those of the range before (two words a range pass through the
driver, and the names of their common letters). A node that only one word has
cannot be shared, so pairs are formed only where both nodes have several words.

The form of a word is its neighbour of largest count, if that is large enough;
counts grow along forms, so chains end, and roots are found by pointer doubling.

Scale. Counting words is a partial aggregation. Pairs of integers are the only
rows that meet, and a pair has at most one row for each letter of the alphabet
and one whole word, so no group is large. No row of the walk holds more than
its word and path: linear in the word, however long.

Edge rows: null text has no words; a null id stands as the empty string in the
checksum; rows that repeat count each; words of other letters than the
alphabet's are cut there; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: One run in so many loses a letter, by its checksum.
TYPO_EVERY = 31
#: Words of a task are counted from its number shifted by this.
SHIFT = 33
ROWS = 10_000
#: A pair's row: a skipped letter equal to the one before, a skipped letter, the whole word.
SAME, SKIP, WHOLE = 0, 1, 2


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): the words of all texts, lower-cased, with the letters lost that the checksum takes."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.col("h") % F.length("run")
    short = F.concat(F.substr("run", F.lit(1), at.cast("int")), F.substr("run", (at + 2).cast("int")))
    word = F.when(F.col("h") % typo_every == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------
# Trie nodes


def shared(a: str, b: str) -> int:
    """Letters that a and b begin with together."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct words of a range -> the path of each as far as another word has
    its nodes; the first and the last word, whose neighbours the task does not see, give it whole."""
    part = TaskContext.get().partitionId()
    base = part << SHIFT
    nodes, count, before = 0, 0, 0
    last: tuple[str, list[int]] | None = None
    rows: list[tuple[str, int, list[int]]] = []

    def flush() -> pa.RecordBatch:
        word, at, path = zip(*rows)
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array([part] * len(word), pa.int32()), pa.array(at, pa.int64()), pa.array(path, pa.list_(pa.int64()))],
            names=["word", "part", "at", "path"])

    for batch in batches:
        for word in batch.column("spelt").to_pylist():
            here = 0
            if last is not None:
                here = shared(last[0], word)
                rows.append((last[0], base + count, last[1] if not count else last[1][: max(before, here)]))
                count += 1
                if len(rows) >= ROWS:
                    yield flush()
            fresh = len(word) - here
            path = (last[1][:here] if here else []) + list(range(base + nodes + 1, base + nodes + fresh + 1))
            nodes += fresh
            last, before = (word, path), here
    if last is not None:
        rows.append((last[0], base + count, last[1]))
        yield flush()


def trie(words: DataFrame, backwards: bool) -> tuple[DataFrame, dict[int, int]]:
    """(spelt, part, at, path) of every word, ``at`` in their order, and the other names of nodes
    that ranges share."""
    spelt = F.reverse("word") if backwards else F.col("word")
    rows = words.select(spelt.alias("spelt")).repartitionByRange("spelt").sortWithinPartitions("spelt")
    rows = written(rows.mapInArrow(_walk, "word string, part int, at long, path array<long>"), "trie")
    ends = rows.groupBy("part").agg(F.min(F.struct("at", "word", "path")).alias("first"), F.max(F.struct("at", "word", "path")).alias("last"))
    names: dict[int, int] = {}
    word, path = "", []
    for r in ends.orderBy("part").collect():  # one row a range
        here = shared(word, r["first"]["word"])
        names.update(zip(r["first"]["path"][:here], path[:here]))
        word, path = r["last"]["word"], [names.get(x, x) for x in r["last"]["path"]]
    return rows, names


def _pairs(forward: dict[int, int], backward: dict[int, int]):
    """(p, s, n, at, kind) of every word; skipping one letter, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s, count, place, kind = [], [], [], [], []

            def add(left: int, right: int, n: int, at: int, what: int) -> None:
                p.append(left)
                s.append(right)
                count.append(n)
                place.append(at)
                kind.append(what)

            for word, n, at, one, two in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "at", "path", "back"))):
                size = len(word)
                if len(one) + len(two) < size - 1:
                    continue  # every pair has a node of this word alone
                left = [0] + [forward.get(x, x) for x in one]
                right = [0] + [backward.get(x, x) for x in two]
                for i in range(max(0, size - len(right)), min(len(left), size)):
                    add(left[i], right[size - 1 - i], n, at, SAME if i and word[i] == word[i - 1] else SKIP)
                for i in range(max(0, size + 1 - len(right)), min(len(left), size + 1)):
                    add(left[i], right[size - i], n, at, WHOLE)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (p, s, count, place)] + [pa.array(kind, pa.int32())],
                                             names=["p", "s", "n", "at", "kind"])

    return run


def neighbours(pairs: DataFrame) -> DataFrame:
    """(at, n_near, best): words that differ in one letter, and (-n, at) of the one with largest n."""
    row = F.struct((-F.col("n")).alias("less"), "at", "kind")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(row).alias("g")).where(F.size("g") > 1)  # bounded by the alphabet

    def near(x: F.Column) -> F.Column:
        replaced = lambda y: (x["kind"] < WHOLE) & (y["kind"] < WHOLE) & (x["at"] != y["at"])
        return F.filter("g", lambda y: replaced(y) | (x["kind"] + y["kind"] == SKIP + WHOLE))

    each = groups.select(F.explode(F.transform("g", lambda x: F.struct(x["at"].alias("at"), near(x).alias("others")))).alias("x"))
    return each.where(F.size("x.others") > 0).groupBy("x.at").agg(
        F.sum(F.size("x.others")).alias("n_near"), F.min(F.array_min("x.others")).alias("best"))


# --------------------------------------------------------------------------
# Forms


def roots(forms: DataFrame) -> DataFrame:
    """(at, root) of rows (at, form): the last form of each chain, by pointer doubling."""
    now = written(forms.select("at", F.col("form").alias("root")), "forms")
    while True:
        hop = now.select(F.col("at").alias("a"), F.col("root").alias("r"))
        now = written(now.join(hop, F.col("root") == F.col("a"), "left").select(
            "at", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n); words are distinct."""
    words = written(words, "words")
    forward, names = trie(words, backwards=False)
    backward, back_names = trie(words, backwards=True)
    back = backward.select(F.reverse("word").alias("w"), F.col("path").alias("back"))
    known = words.select(F.col("word").alias("w2"), "n")
    both = forward.join(back, F.col("word") == F.col("w")).join(known, F.col("word") == F.col("w2"))
    rows = written(both.select("word", "n", "at", "path", "back"), "paths")
    pairs = rows.mapInArrow(_pairs(names, back_names), "p long, s long, n long, at long, kind int")
    near = neighbours(pairs).withColumnRenamed("at", "a")
    best = -F.col("best.less")
    out = rows.select("word", "n", "at").join(near, F.col("at") == F.col("a"), "left")
    out = written(out.select("word", "n", "at", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(best >= ratio * F.col("n"), F.col("best.at")).alias("form_at")), "near")
    ends = roots(out.where("form_at IS NOT NULL").select("at", F.col("form_at").alias("form"))).select(F.col("at").alias("a"), F.col("root").alias("root_at"))
    spelt = out.select(F.col("at").alias("f"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ending = out.select(F.col("at").alias("r"), F.col("word").alias("root"))
    linked = ends.join(ending, F.col("root_at") == F.col("r")).select("a", "root")
    has = out.where("form_at IS NOT NULL").join(spelt, F.col("form_at") == F.col("f")).join(linked, F.col("at") == F.col("a"))
    none = out.where("form_at IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near",
                                               F.lit(None).cast("long").alias("form_n"))
    return has.select("word", "form", "root", "n", "n_near", "form_n").unionByName(none)


def variants(docs: DataFrame, **options) -> DataFrame:
    """The words of docs with their forms and roots."""
    return grouped(vocabulary(docs, **options))
