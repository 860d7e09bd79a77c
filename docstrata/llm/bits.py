"""Membership bits: which rows of a large table a smaller one may name.

To drop or fetch a few rows of a table with texts, the texts must not be
shuffled: the hashes of the few rows' keys set bits, the table is scanned with
them, and only rows whose bits are set meet the few in a join, which decides.

Tasks send the places of their bits, which merge by shard; the driver holds
2**MAX_BITS / 8 bytes (16 MB) at most and gives them to the tasks. The number
of bits follows the number of keys; beyond MAX_BITS / KEY_BITS keys the bits
fill, and more rows take part in the join. No key is ever missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import U64, mix, written

MIN_BITS, MAX_BITS = 16, 27
#: Bits for a key.
KEY_BITS = 16
HASHES = 2
SHARD_BITS = 8


def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (mix(h.view(U64) + U64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) >> U64(64 - bits)).astype(np.int64)


@dataclass
class Bits:
    bits: int
    shards: dict[int, bytes]

    def __post_init__(self):
        self._data: np.ndarray | None = None

    def __getstate__(self):
        return {"bits": self.bits, "shards": self.shards, "_data": None}

    def data(self) -> np.ndarray:
        if self._data is None:
            size = 1 << (self.bits - SHARD_BITS - 3)
            self._data = np.zeros(size << SHARD_BITS, np.uint8)
            for s, packed in self.shards.items():
                self._data[s * size: (s + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return self._data

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in places(h, self.bits):
            out &= (self.data()[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def _set_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(places(np.asarray(batch.column("h")), bits))))
            cut = np.searchsorted(at, np.arange((1 << SHARD_BITS) + 1, dtype=np.int64) << (bits - SHARD_BITS))
            some = np.flatnonzero(np.diff(cut))
            low = (at & ((1 << (bits - SHARD_BITS)) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([low[cut[s]: cut[s + 1]].tobytes() for s in some.tolist()], pa.binary())],
                names=["shard", "low"])

    return run


def _merged(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = -1, np.zeros(0, bool)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(dense).tobytes(), 1)], pa.binary())],
                                              names=["shard", "bits"])

        for batch in batches:
            for shard, low in zip(batch.column("shard").to_pylist(), batch.column("low").to_pylist()):
                if shard != now:
                    if now >= 0:
                        yield row()
                    now, dense = shard, np.zeros(1 << (bits - SHARD_BITS), bool)
                dense[np.frombuffer(low, np.uint32)] = True
        if now >= 0:
            yield row()

    return run


def bits_of(keys: DataFrame) -> Bits:
    """The bits of the rows of a written table (h long)."""
    size = min(max(int(keys.count() * KEY_BITS).bit_length(), MIN_BITS), MAX_BITS)
    parts = keys.mapInArrow(_set_rows(size), "shard int, low binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merged(size), "shard int, bits binary")
    return Bits(size, {r["shard"]: bytes(r["bits"]) for r in merged.collect()})  # 2**MAX_BITS / 8 bytes at most


def may_hold(bits: Bits, h: F.Column) -> F.Column:
    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        return pa.array(bits.may_hold(np.asarray(values)))

    return test(h)


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """The rows (with their other columns) whose keys, never null, no row of ``gone`` (keys) has."""
    gone = written(gone.select(*[F.col(k).alias(f"_{k}") for k in keys], F.xxhash64(*keys).alias("h")), "gone")
    found = bits_of(gone.select("h"))
    maybe = may_hold(found, F.xxhash64(*keys))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    left = rows.where(maybe).join(gone.drop("h"), same, "left_anti")
    return rows.where(~maybe).unionByName(left)
