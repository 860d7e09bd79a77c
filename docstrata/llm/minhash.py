"""Near-duplicate documents by fast similarity sketching.

A document is its set of distinct word shingles. Its sketch has ``COORDS``
coordinates, filled in rounds: in round i < COORDS every shingle is thrown
into a random bin with a value in [i, i + 1), after that round i fills bin
i - COORDS; a coordinate keeps its least value and rounds stop when all
are filled. Coordinates of two documents agree with the probability of
their Jaccard similarity, with the concentration of an independent sample,
also for short documents. Bands of ``BAND`` coordinates give candidate
buckets (a pair at 0.8 meets in none with probability 5e-8; with ``LOW`` below
6e-8 in all); links are confirmed on the full shingle sets of the texts.

No pairs of a group are listed. Documents of equal sets are one class.
Buckets of the same members count once. First a class is compared, by
sketch, with the leaders of its buckets only, and its ``ASKED`` likeliest
are confirmed. These links give components; then buckets whose members lie
in more than one component are met again with the shingle sets: every pair
across components whose estimate is not below ``LOW`` (six standard errors
under the threshold: a pair at 0.8 falls below it with probability 1e-9) is
judged inside the task on 64-bit hashes, with one shingle of slack, and the few
that may link are confirmed. So every pair that meets is inside a component or
judged, in the first band that its full keys share.

Scale. Classes, copies and buckets are partial aggregations; a bucket of more
than ``BLOCK`` classes is dealt out: in the first step over blocks that share
its first member; in the second the classes of its largest component stay in
their block and only the others, which must meet all, go to every block.

Edge rows: null or word-less text has an empty set and links with nothing;
a text of fewer words than a shingle is one shingle; a null id sorts last
and returns null, and of a group of null ids one document stays in the pipeline; rows given twice come back twice; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.bits import without
from docstrata.llm.common import (_LOWER, MAX_LONG, U64, keyed, mix, prefix_sums, range_hash, release, string_bytes, text_pieces, with_breaks,
                                  word_spans, written)
from docstrata.llm.components import components
from docstrata.llm.repeats import whole_groups

WORDS = 2
PERCENT = 80
COORDS = 128
BAND = 4
HIGH = 0.9
LOW = 0.58
#: Leaders that a class is compared with in the first step.
ASKED = 4
BLOCK = 4096


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, in order of text and hash, and their offsets by text."""
    n = len(offs) - 1
    data, offs = with_breaks(_LOWER[data], offs)
    starts, ends = word_spans(data)
    h = range_hash(prefix_sums(data), starts, ends)
    row = np.searchsorted(offs, starts, side="right") - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    size = np.minimum(words, count)[row] if len(row) else row  # a short text is one shingle
    last = (first + count)[row] if len(row) else row
    at = np.arange(len(h))
    whole = at + size <= last
    s = np.zeros(len(h), U64)
    for k in range(words):
        use = k < size
        s = np.where(use, mix(s * U64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, max(len(h) - 1, 0))] + U64(k)), s) if len(h) else s
    s = mix(s + size.astype(U64))
    row, s = row[whole], s[whole]
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
    row, s = row[new], s[new]
    return s, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


def sketches(s: np.ndarray, offs: np.ndarray, coords: int) -> np.ndarray:
    """Fast similarity sketches (texts x coords); rows of empty sets stay at the greatest value."""
    n = len(offs) - 1
    empty = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * coords, empty, U64)
    text = np.repeat(np.arange(n), np.diff(offs))
    low = U64((1 << 55) - 1)
    for i in range(2 * coords):
        if not len(text):
            break
        x = mix(s + U64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
        bins = ((x >> U64(32)) % U64(coords)).astype(np.int64) if i < coords else np.full(len(s), i - coords)
        at = text * coords + bins
        free = out[at] == empty  # bins of earlier rounds keep their smaller values
        at = at[free]
        np.minimum.at(out, at, U64(i << 55) | (mix(x[free]) & low))
        todo = (out.reshape(n, coords) == empty).any(1)
        keep = todo[text]
        text, s = text[keep], s[keep]
    return out.reshape(n, coords)


def _sketch_rows(words: int, coords: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_pieces(batch):
                s, offs = shingle_sets(*string_bytes(b.column("text")), words)
                sk = sketches(s, offs, coords)
                keys = np.zeros((len(sk), coords // band), U64)
                for j in range(band):
                    keys = mix(keys * U64(0x9E3779B97F4A7C15) + sk[:, j::band] + U64(j + 1))
                keys = mix(keys + np.arange(coords // band, dtype=np.int64).astype(U64) * U64(0xD6E8FEB86659FD93))
                sizes = np.diff(offs)
                sigs = [hashlib.blake2b(s[a:c].tobytes(), digest_size=16).digest() if c > a else None for a, c in zip(offs[:-1], offs[1:])]
                per = coords // band
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sk) + 1) * per, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                short = mix(sk).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("dk"), b.column("rid"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                     bands, pa.array([r.tobytes() for r in short], pa.binary())],
                    names=["doc_id", "dk", "rid", "n", "sig", "bands", "sketch"])

    return run


# --------------------------------------------------------------------------
# Candidates


@dataclass
class Bucket:
    """Rows of one bucket (or of a cell of it): classes with sizes, blocks, sketches, and for
    the second step whether they are of the largest component, components, band keys and sets."""

    sig: list
    n: np.ndarray
    part: np.ndarray
    cell: int
    band: int
    main: np.ndarray
    comp: list
    sketch: np.ndarray
    bands: np.ndarray
    sets: list


def _pairs(rule, percent: int, sized_by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "cell"], sized_by):
            change = np.ones(table.num_rows, bool)
            key, cell = np.asarray(table.column("key")), np.asarray(table.column("cell"))
            change[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            cuts = np.append(np.flatnonzero(change), table.num_rows).tolist()
            sig, comp = table.column("sig").to_pylist(), table.column("comp").to_pylist()
            n, part, no, main = (np.asarray(table.column(c)) for c in ("n", "part", "band", "main"))
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            flat = pa.concat_arrays([c.flatten() for c in table.column("bands").chunks])  # no object for each key
            bands = flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, len(flat) // table.num_rows)
            sets = table.column("shingles").to_pylist()
            a, b, est = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                bucket = Bucket(sig[lo:hi], n[lo:hi], part[lo:hi], int(cell[lo]), int(no[lo]), main[lo:hi], comp[lo:hi], sk[lo:hi], bands[lo:hi], sets[lo:hi])
                for i, j, e in rule(bucket, percent):
                    a.append(sig[lo + i])
                    b.append(sig[lo + j])
                    est.append(e)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(est, pa.float64())], names=["a", "b", "est"])
            del sig, comp, sk, flat, bands, sets, a, b, est
            release()

    return run


def _alike(sk: np.ndarray, n: np.ndarray, i: int, rows: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of row i with rows; 0 where the sizes alone rule a link out."""
    est = (sk[rows] == sk[i]).mean(1)
    est[100 * np.minimum(n[rows], n[i]) < percent * np.maximum(n[rows], n[i])] = 0
    return est


def by_leaders(b: Bucket, percent: int) -> Iterator[tuple[int, int, float]]:
    """(leader, class): a class against the leaders of its bucket; one at HIGH
    settles it, else the two likeliest of different groups of leaders are
    asked. The second step sees to what these leave open."""
    parent = list(range(len(b.sig)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    leaders = np.zeros(len(b.sig), np.int64)
    count = 0
    for i in range(len(b.sig)):
        best = 0.0
        if count:
            est = _alike(b.sketch, b.n, i, leaders[:count], percent)
            asked = 0
            for q in np.argsort(-est, kind="stable").tolist():
                if est[q] < LOW or asked == 2:
                    break
                best = best or est[q]
                j = int(leaders[q])
                root = find(j)
                if find(i) != root:
                    yield j, i, float(est[q])
                    asked += 1
                    if est[q] >= percent / 100 + 0.05:  # almost surely a link: what it joins need not be asked
                        parent[find(i)] = root
                if best >= HIGH:
                    break
        if best < HIGH:
            leaders[count] = i
            count += 1


def across(b: Bucket, percent: int) -> Iterator[tuple[int, int, float]]:
    """Pairs of different components that may link by their shingle sets. Classes outside
    the largest component are in all cells: two of them are judged in the cell of the
    first one's block, and every pair in the first band it shares."""
    names = {c: k for k, c in enumerate(dict.fromkeys(b.comp))}
    if len(names) < 2:
        return
    label = np.array([names[c] for c in b.comp])
    sets = [np.frombuffer(x, U64) for x in b.sets]
    size = np.array([len(x) for x in sets])
    for i in np.flatnonzero(~b.main).tolist():
        later = np.arange(len(label)) > i
        rows = np.flatnonzero((label != label[i]) & (b.main | (later if b.part[i] == b.cell else False)))
        rows = rows[_alike(b.sketch, b.n, i, rows, percent) >= LOW] if len(rows) else rows
        rows = rows[~(b.bands[rows, : b.band] == b.bands[i, : b.band]).any(1)] if len(rows) and b.band else rows
        if not len(rows):
            continue
        flat = np.concatenate([sets[j] for j in rows.tolist()])
        at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size[rows]) - size[rows])
        for j in rows[100 * (both + 1) >= percent * (size[i] + size[rows] - both - 1)].tolist():
            yield i, j, 1.0


def _shingles(text: str, words: int) -> set:
    w = text.encode().lower().split()  # bytes: only A-Z change, only the six white space bytes split
    return {tuple(w)} if 0 < len(w) < words else set(zip(*(w[k:] for k in range(words)))) if w else set()


def _set_rows(words: int):
    """(sig, shingles): the sets as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_pieces(batch):
                s, offs = shingle_sets(*string_bytes(b.column("text")), words)
                yield pa.RecordBatch.from_arrays(
                    [b.column("sig"), pa.array([s[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:])], pa.binary())],
                    names=["sig", "shingles"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for b in batches:
            ok = []
            for x, y in zip(b.column("text_a"), b.column("text_b")):
                x = x.as_py()
                if x != last:
                    last, one = x, _shingles(x, words)
                two = _shingles(y.as_py(), words)
                both = len(one & two)
                ok.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "linked"])
            last, one = None, set()
            release()

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) of each pair on the full sets."""
    one = texts.select(F.col("sig").alias("sa"), F.col("text").alias("text_a"))
    two = texts.select(F.col("sig").alias("sb"), F.col("text").alias("text_b"))
    rows = pairs.join(two, F.col("b") == F.col("sb")).join(one, F.col("a") == F.col("sa")).select("a", "b", "text_a", "text_b")
    return written(rows.mapInArrow(_confirm(words, percent), "a binary, b binary, linked boolean"), "minhash-links")


def near_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, coords: int = COORDS, band: int = BAND,
                   block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and the key columns dk, rid, of every row."""
    rows = keyed(docs, id_col, text_col)
    base = written(rows.mapInArrow(_sketch_rows(words, coords, band),
                                   "doc_id long, dk long, rid long, n long, sig binary, bands array<long>, sketch binary"), "minhash-sketches")
    classes = base.where("sig IS NOT NULL").groupBy("sig").agg(
        F.min_by(F.struct("dk", "rid", "n", "bands", "sketch"), F.struct("dk", "rid")).alias("c"))
    classes = written(classes.select("sig", "c.*"), "minhash-classes")

    # buckets of two classes or more; those of the same members once
    crowd = classes.select(F.posexplode("bands").alias("band", "key"), "sig")
    buckets = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("band").alias("band"), F.min("sig").alias("lead"),
                                       F.sum(F.xxhash64("sig").cast("decimal(20,0)")).cast("string").alias("mark")).where("members > 1")
    buckets = written(buckets.groupBy("members", "lead", "mark").agg(F.min_by("key", "band").alias("k")).drop("mark"), "minhash-buckets")
    member = crowd.join(buckets, F.col("key") == F.col("k")).select("key", "band", "sig", "members", "lead")
    known = classes.select(F.col("sig").alias("s"), "n", "sketch", "dk", "rid")
    member = written(member.join(known, F.col("sig") == F.col("s")).drop("s"), "minhash-members")
    wanted = member.select("sig", F.col("dk").alias("d"), F.col("rid").alias("r")).distinct()
    texts = rows.join(wanted, (F.col("dk") == F.col("d")) & (F.col("rid") == F.col("r")))
    texts = written(texts.select("sig", "text").dropDuplicates(["sig"]), "minhash-texts")

    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    member = member.drop("dk", "rid").withColumn("blocks", blocks).withColumn("part", part)

    def run(dealt: DataFrame, rule, sized_by: str) -> DataFrame:
        cols = dealt.select("key", "cell", "band", "sig", "n", "part", "main", "comp", "sketch", "keys", "shingles").withColumnRenamed("keys", "bands")
        pairs = cols.repartition("key", "cell").sortWithinPartitions("key", "cell", "sig").mapInArrow(
            _pairs(rule, percent, sized_by), "a binary, b binary, est double")
        return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))

    def undirected(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # the first member of a dealt-out bucket is in all its blocks
    cells = F.when(F.col("sig") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("part"))
    empty = F.lit(None).cast("binary")
    dealt = member.withColumn("cell", F.explode(cells)).withColumn("comp", empty).withColumn("shingles", empty)
    first = run(dealt.withColumn("main", F.lit(False)).withColumn("keys", F.array().cast("array<bigint>")), by_leaders, "sketch")
    # the likeliest of a class's leaders over all its buckets; the second step needs no more to be exact
    likely = Window.partitionBy("b").orderBy(F.desc("est"), "a")
    first = first.withColumn("r", F.row_number().over(likely)).where(f"r <= {ASKED}")
    links = confirmed(undirected(first), texts, words, percent)

    found = components(links.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    label = found.select(F.col("node").alias("s"), F.col("component").alias("c"))
    left = member.join(label, F.col("sig") == F.col("s"), "left").withColumn("comp", F.coalesce("c", "sig")).drop("s", "c")
    sizes = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("kinds"), F.max_by("comp", F.struct("c", "comp")).alias("largest"))
    # written, so that the join below meets two plain exchanges, whose hot keys Spark can split
    mixed = written(mixed.where("kinds > 1").drop("kinds"), "minhash-mixed")
    left = left.join(mixed, F.col("key") == F.col("k")).withColumn("main", F.col("comp") == F.col("largest"))
    sets = texts.select("sig", "text").mapInArrow(_set_rows(words), "sig binary, shingles binary").withColumnRenamed("sig", "s")
    left = left.join(sets, F.col("sig") == F.col("s")).drop("s").join(
        classes.select(F.col("sig").alias("s"), F.col("bands").alias("keys")), F.col("sig") == F.col("s")).drop("s")
    cells = F.when(F.col("main"), F.array("part")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = run(left.withColumn("cell", F.explode(cells)), across, "shingles")
    more = confirmed(undirected(rest), texts, words, percent).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # whole components are nodes now
    done = components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    named = classes.select("sig", "dk", "rid").join(done.withColumnRenamed("node", "s"), F.col("sig") == F.col("s"), "left").drop("s")
    named = named.withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("dk", "rid")).alias("least"))
    named = named.join(least, F.col("component") == F.col("c")).select(F.col("sig").alias("s"), "least")
    out = base.select("doc_id", "dk", "rid", "n", "sig").join(named, F.col("sig") == F.col("s"), "left")
    least = F.coalesce("least", F.struct("dk", "rid"))
    own = least["dk"]
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own != MAX_LONG, own).alias("component_id"),
                      (F.col("dk") == own).alias("kept"), "dk", "rid", (least == F.struct("dk", "rid")).alias("first"))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one document of each group (that of the least id, of the
    least hash of its text where ids are equal or null), with their columns."""
    gone = near_documents(docs, **options).where(~F.col("first")).select("dk", "rid")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("dk"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rid"))
    return without(rows, ["dk", "rid"], gone).select("row.*")
