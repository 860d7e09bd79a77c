"""Repeated windows of a corpus: the plan that the substring operators share.

A window is ``length`` consecutive tokens of one document. All its grams of
``gram`` tokens lie inside it, so the gram of least hash, its anchor, is a
function of its content: equal windows have equal anchors at equal places.
Consecutive windows mostly share an anchor, which makes a row per anchor
(a segment: the tokens of its windows) instead of one per window.

1. A sketch counts anchors. Each task sends sorted cells with counts; shards
   of the sketch are merged by adding. Cells met twice or more are kept as
   bits and go to all workers (their size is fixed by ``bits`` and ``depth``).
   A cell never counts less than a window of it: none is lost. Where a corpus
   is so large that the bits fill up, more segments are sent, the result
   stays the same.
2. Segments whose anchor may be repeated are shuffled by anchor. A cell of
   more than ``hot`` anchors is dealt out over count / hot salts.
3. A group's windows are compared exactly; all but the first are repeats.
   What is first inside a salt of a hot anchor is compared once more, one
   row per window, by the window's own hash.

A repeat comes back as (dk, rid, start, end), merged into runs per segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import (U64, binary_array, mix, prefix_sums, range_hash, sliding_min, string_bytes, written)

#: Bits of a position inside a block of tokens.
PLACE = 22
#: Tokens whose windows are anchored at a time.
BLOCK = 1 << 18
SHARD_BITS = 6
#: Bytes of segments that are compared at a time (whole groups).
PIECE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``length`` tokens, anchored by grams of ``gram`` tokens."""

    length: int
    gram: int
    bits: int
    depth: int
    hot: int = 10_000

    @property
    def grams(self) -> int:
        return self.length - self.gram + 1


@dataclass
class Block:
    """Tokens of some documents: byte data, token bounds in it, and for each token its document's end token.

    ``row`` is the document's row, ``first`` its first token's place in the document.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    place: np.ndarray
    last: np.ndarray


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, place: np.ndarray, length: int) -> Iterator[Block]:
    """Blocks of tokens that overlap by a window less one; every window starts in one of them."""
    n = len(starts)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK + length - 1)
        if hi - lo < length:
            break
        a, b = int(starts[lo]), int(ends[hi - 1])
        r = row[lo:hi]
        edge = np.append(np.flatnonzero(r[1:] != r[:-1]) + 1, hi - lo)
        last = np.repeat(edge, np.diff(np.concatenate(([0], edge))))
        yield Block(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a, r, place[lo:hi], last)


def gram_hashes(sums: np.ndarray, b: Block, size: int) -> np.ndarray:
    """Hash of the tokens i .. i + size - 1 with what is between them."""
    n = len(b.starts) - size + 1
    return range_hash(sums, b.starts[:n], b.ends[size - 1:])


def anchored(h: np.ndarray, b: Block, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the anchor) of each run of windows with one anchor."""
    n = len(b.starts) - rule.length + 1
    low = U64((1 << PLACE) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.int64).astype(U64)
    at = (sliding_min(packed, rule.grams)[:n] & low).astype(np.int64)
    start = np.arange(n)
    whole = start + rule.length <= b.last[:n]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return first, first, h[:0]
    run = np.add.reduceat(whole.astype(np.int64), first)
    return first, run, h[at[first]]


Reader = Callable[[pa.RecordBatch], Iterator[Block]]


# --------------------------------------------------------------------------
# 1. The sketch


def cells(h: np.ndarray, rule: Rule, row: int) -> np.ndarray:
    return mix(h + U64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64))) >> U64(64 - rule.bits)


def _sketch_rows(read: Reader, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            all_ = np.concatenate(got)
            got.clear()
            shard, ids, counts = [], [], []
            low = rule.bits - SHARD_BITS
            for d in range(rule.depth):
                cell, n = np.unique(cells(all_, rule, d), return_counts=True)
                cut = np.searchsorted(cell, np.arange((1 << SHARD_BITS) + 1, dtype=np.int64).astype(U64) << U64(low))
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                    if a < b:
                        shard.append(d << SHARD_BITS | s)
                        ids.append((cell[a:b] & U64((1 << low) - 1)).astype(np.uint32).tobytes())
                        counts.append(zlib.compress(n[a:b].astype(np.uint32).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                              names=["shard", "ids", "counts"])

        held = 0
        for batch in batches:
            for b in read(batch):
                first, _, h = anchored(gram_hashes(prefix_sums(b.data), b, rule.gram), b, rule)
                got.append(h)
                held += len(first)
                if held >= 1 << 23:
                    yield rows()
                    held = 0
        if held:
            yield rows()

    return run


def _merge_shards(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = -1, np.zeros(0, np.uint32)

        def row() -> pa.RecordBatch:
            hot = np.flatnonzero(dense >= rule.hot)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(dense >= 2).tobytes(), 1)], pa.binary()),
                 pa.array([hot.tolist()], pa.list_(pa.int64())), pa.array([dense[hot].tolist()], pa.list_(pa.int64())),
                 pa.array([int(dense.sum(dtype=np.int64))], pa.int64())],
                names=["shard", "twice", "hot", "counts", "total"])

        for batch in batches:
            for shard, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "counts"))):
                if shard != now:
                    if now >= 0:
                        yield row()
                    now, dense = shard, np.zeros(1 << (rule.bits - SHARD_BITS), np.uint32)
                dense[np.frombuffer(ids, np.uint32)] += np.frombuffer(zlib.decompress(counts), np.uint32)
        if now >= 0:
            yield row()

    return run


@dataclass
class Sketch:
    """Bits of the cells met twice or more, by row of the sketch, and the hot cells with their counts."""

    rule: Rule
    shards: dict[int, bytes]
    hot: list[dict[int, int]]

    def __post_init__(self):
        self._rows: list[np.ndarray] | None = None

    def rows(self) -> list[np.ndarray]:
        if self._rows is None:
            size = 1 << (self.rule.bits - SHARD_BITS - 3)
            self._rows = [np.zeros(size << SHARD_BITS, np.uint8) for _ in range(self.rule.depth)]
            for shard, packed in self.shards.items():
                d, s = shard >> SHARD_BITS, shard & ((1 << SHARD_BITS) - 1)
                self._rows[d][s * size: (s + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return self._rows

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Anchors whose estimated count is 2 or more."""
        keep = np.ones(len(h), bool)
        for d, bits in enumerate(self.rows()):
            cell = cells(h, self.rule, d)
            keep &= (bits[(cell >> U64(3)).astype(np.int64)] >> (U64(7) - (cell & U64(7))).astype(np.uint8)) & 1 == 1
        return keep

    def salts(self, h: np.ndarray) -> np.ndarray:
        """Parts over which an anchor is dealt out; the least count of its cells decides."""
        out = np.ones(len(h), np.int64)
        if not all(self.hot):
            return out
        least = None
        for d, hot in enumerate(self.hot):
            keys = np.array(sorted(hot), np.int64)
            cell = cells(h, self.rule, d).astype(np.int64)
            at = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
            n = np.where(keys[at] == cell, np.array([hot[k] for k in keys.tolist()], np.int64)[at], 0)
            least = n if least is None else np.minimum(least, n)
        return np.maximum(out, -(-least // self.rule.hot))

    def __getstate__(self):
        return {"rule": self.rule, "shards": self.shards, "hot": self.hot, "_rows": None}


def sketch(docs: DataFrame, read: Reader, rule: Rule) -> Sketch:
    parts = docs.mapInArrow(_sketch_rows(read, rule), "shard int, ids binary, counts binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _merge_shards(rule), "shard int, twice binary, hot array<long>, counts array<long>, total long")
    merged = written(merged, "sketch")
    total = (merged.agg(F.sum("total")).first()[0] or 0) // max(rule.depth, 1)
    floor = max(rule.hot, total // 100_000)  # so that hot cells are 100,000 a row of the sketch at most
    over = F.filter(F.arrays_zip(F.col("hot").alias("c"), F.col("counts").alias("n")), lambda x: x["n"] >= floor)
    # 2**bits / 8 bytes a row of the sketch at most, whatever the corpus holds, and the cells that reach the floor
    rows = merged.select("shard", "twice", over["c"].alias("hot"), over["n"].alias("counts")).collect()
    hot: list[dict[int, int]] = [{} for _ in range(rule.depth)]
    for r in rows:
        base = (r["shard"] & ((1 << SHARD_BITS) - 1)) << (rule.bits - SHARD_BITS)
        hot[r["shard"] >> SHARD_BITS].update({base + c: n for c, n in zip(r["hot"], r["counts"])})
    return Sketch(rule, {r["shard"]: bytes(r["twice"]) for r in rows}, hot)


# --------------------------------------------------------------------------
# Exact comparison


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``lens`` bytes at a and at b are equal."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    eight = np.zeros(len(data), U64)  # the eight bytes from each place on
    for k in range(8):
        eight[: len(data) - k] |= data[k:].astype(U64) << U64(8 * k)
    longest = int(lens.max())
    for o in range(0, longest, 8):
        # the last load of a range lies flush with its end; shorter ranges mask it
        here = lens > o
        at = np.where(lens >= 8, np.minimum(o, lens - 8), 0)
        x, y = eight[np.minimum(a + at, len(data) - 1)], eight[np.minimum(b + at, len(data) - 1)]
        gap = np.where(lens >= 8, 0, (8 - lens) * 8).clip(0, 63).astype(U64)
        out &= ~here | ((x << gap) == (y << gap)) | (lens == 0)
    return out


def firsts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """For each range, the first range of equal bytes (itself if there is none before).

    ``keys`` are digits of the ranges' content, the most significant first:
    each pass orders what is left by the next digit and drops what has
    become single; what is equal in all digits is compared by bytes.
    """
    n = len(starts)
    out = np.arange(n)
    left = np.arange(n)
    group = np.zeros(n, np.int64)
    for key in keys:
        if not len(left):
            break
        h = mix(key[left] + mix(group.astype(U64) + U64(1)))
        order = np.argsort(h, kind="stable")
        left, h = left[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        many = np.repeat(size > 1, size)
        left = left[many]
        group = np.cumsum(new)[many]
    if not len(left):
        return out
    new = np.ones(len(left), bool)
    new[1:] = group[1:] != group[:-1]
    first = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
    rest = ~new
    a, b = first[rest], left[rest]
    lens = ends[b] - starts[b]
    same = (ends[a] - starts[a] == lens)
    same[same] = same_bytes(data, starts[a[same]], starts[b[same]], lens[same])
    out[b[same]] = a[same]
    if not same.all():  # equal digits, other bytes: settle these groups on the bytes themselves
        seen: dict[bytes, int] = {}
        odd = np.unique(group[rest][~same])
        for i in left[np.isin(group, odd)].tolist():
            out[i] = seen.setdefault(data[starts[i]: ends[i]].tobytes(), i)
    return out


def runs(flag: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags inside one row."""
    edge = np.ones(len(flag), bool)
    edge[1:] = (row[1:] != row[:-1]) | (flag[1:] != flag[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(flag)) - 1
    set_ = flag[begin]
    return begin[set_], end[set_]


SEGMENTS = "key long, salt int, salts int, dk long, rid long, first long, n int, seg binary"
SPANS = "dk long, rid long, start long, end long"


def _segments(read: Reader, rule: Rule, shared: Broadcast, write: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]):
    """Rows of the segments whose anchor may be repeated; equal segments of a block are sent once.

    A copy inside the block goes out as a row without segment (n < 0): it is
    a repeat whatever else there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk: Sketch = shared.value
        for batch in batches:
            dk, rid = (np.asarray(batch.column(c)) for c in ("dk", "rid"))
            for b in read(batch):
                sums = prefix_sums(b.data)
                first, n, h = anchored(gram_hashes(sums, b, rule.gram), b, rule)
                keep = sk.repeated(h)
                first, n, h = first[keep], n[keep], h[keep]
                if not len(first):
                    continue
                d, r, p = dk[b.row[first]], rid[b.row[first]], b.place[first]
                order = np.lexsort((p, r, d))
                first, n, h, d, r, p = (x[order] for x in (first, n, h, d, r, p))
                at, to = b.starts[first], b.ends[first + n + rule.length - 2]
                lead = firsts(b.data, at, to, [range_hash(sums, at, to)])
                # a copy at the very place of the first (a row given twice) is no repeat, and adds nothing
                alone = lead == np.arange(len(lead))
                later = ~alone & ((d != d[lead]) | (r != r[lead]) | (p != p[lead]))
                if later.any():
                    m = int(later.sum())
                    spread = mix(d[later].astype(U64) + p[later].astype(U64))
                    yield _rows(spread, np.ones(m, np.int64), d[later], r[later], p[later], -n[later], pa.array([b""] * m, pa.binary()))
                first, n, h, d, r, p, at, to = (x[alone] for x in (first, n, h, d, r, p, at, to))
                salts = sk.salts(h)
                step = max(1, PIECE // max(1, int((to - at).max())))
                for lo in range(0, len(h), step):
                    s = slice(lo, lo + step)
                    yield _rows(h[s], salts[s], d[s], r[s], p[s], n[s], write(b.data, at[s], to[s]))

    def _rows(h, salts, d, r, p, n, seg) -> pa.RecordBatch:
        salt = mix(d.astype(U64)) % salts.astype(U64)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(d), pa.array(r),
             pa.array(p.astype(np.int64)), pa.array(n.astype(np.int32)), seg],
            names=["key", "salt", "salts", "dk", "rid", "first", "n", "seg"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: str, limit: int = PIECE) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of column ``size`` that never cut a group of equal keys (rows sorted by them)."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.column(size).nbytes
        if have < limit:
            continue
        table = pa.Table.from_batches(held)
        # up to the last change of key
        cols = [np.asarray(table.column(k)) for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        if len(cuts):
            cut = int(cuts[-1])
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut).combine_chunks()
        held, have = table.to_batches(), table.column(size).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


FOUND = f"{SPANS}, hash long, content binary"


def _compare(rule: Rule, windows: Callable, digits: Callable):
    """Repeats of each group as spans; for hot anchors also the windows that are first in their salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "salt"], "seg"):
            d, r, p, n, salts = (np.asarray(table.column(c)) for c in ("dk", "rid", "first", "n", "salts"))
            order = np.lexsort((p, r, d))
            table = table.take(pa.array(order))
            d, r, p, n, salts = (x[order] for x in (d, r, p, n, salts))
            data, offs = string_bytes(table.column("seg").combine_chunks())
            starts, ends, row, k = windows(data, offs, n)
            at = p[row] + k
            # windows in the order of their places, so that the first of a group is its earliest
            lead = firsts(data, starts, ends, digits(data, starts, ends))
            later = (lead != np.arange(len(lead))) & ((d[row] != d[row[lead]]) | (r[row] != r[row[lead]]) | (at != at[lead]))
            a, b = runs(later, row)
            yield _found(d[row[a]], r[row[a]], at[a], at[b] + rule.length, np.zeros(len(a), np.int64), pa.nulls(len(a), pa.binary()))
            again = np.flatnonzero((lead == np.arange(len(lead))) & (salts[row] > 1))
            if len(again):
                h = range_hash(prefix_sums(data), starts[again], ends[again]).view(np.int64)
                yield _found(d[row[again]], r[row[again]], at[again], at[again] + rule.length, h, binary_array(data, starts[again], ends[again]))

    return run


def _found(d, r, start, end, h, content) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, r, start.astype(np.int64), end.astype(np.int64), h)] + [content],
                                      names=["dk", "rid", "start", "end", "hash", "content"])


def repeats(docs: DataFrame, rule: Rule, read: Reader, write: Callable, windows: Callable, digits: Callable) -> DataFrame:
    """(dk, rid, start, end): token ranges of keyed docs that windows starting earlier elsewhere cover."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(docs, read, rule))
    rows = docs.mapInArrow(_segments(read, rule, shared, write), SEGMENTS)
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = written(rows.mapInArrow(_with_local(_compare(rule, windows, digits), rule), FOUND), "repeats")
    spans = found.where("content IS NULL").select("dk", "rid", "start", "end")
    # the windows that are first in a salt of a hot anchor: at most one row a window and salt
    again = found.where("content IS NOT NULL")
    best = again.groupBy("hash", "content").agg(F.min(F.struct("dk", "rid", "start")).alias("best"))
    best = best.select(F.col("hash").alias("h"), F.col("content").alias("c"), "best")
    later = again.join(best, (F.col("hash") == F.col("h")) & (F.col("content") == F.col("c"))).where(
        F.struct("dk", "rid", "start") > F.col("best")).select("dk", "rid", "start", "end")
    return spans.unionByName(later)


def _with_local(compare, rule: Rule):
    """Copies that were found inside a block pass by the comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def rest() -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = np.asarray(b.column("n"))
                local = n < 0
                if local.any():
                    own = b.filter(pa.array(local))
                    d, r, p, m = (np.asarray(own.column(c)) for c in ("dk", "rid", "first", "n"))
                    passed.append(_found(d, r, p, p - m.astype(np.int64) + rule.length - 1, np.zeros(len(d), np.int64), pa.nulls(len(d), pa.binary())))
                    b = b.filter(pa.array(~local))
                if b.num_rows:
                    yield b

        for out in compare(rest()):
            yield from passed
            passed.clear()
            yield out
        yield from passed

    return run


def spans_of(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed docs with a column spans: array of (start, end), null where there are none."""
    per = spans.groupBy(F.col("dk").alias("d"), F.col("rid").alias("r")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(per, (F.col("dk") == F.col("d")) & (F.col("rid") == F.col("r")), "left").select("doc_id", "text", "spans")


def covered(n: int, spans: pa.Array | None) -> np.ndarray:
    """Tokens 0 .. n - 1 that a span covers."""
    out = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        np.add.at(out, np.asarray(spans.field("start")), 1)
        np.add.at(out, np.asarray(spans.field("end")), -1)
    return np.cumsum(out[:n]) > 0
