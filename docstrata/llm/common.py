"""Helpers shared by the training-data operators: document keys, written
stages, and byte / word kernels over Arrow batches.

Document identity. A document is named by ``doc_id``; rows that agree in
``doc_id`` and text are one document given twice, rows of one ``doc_id``
with other texts are documents of their own, ordered by a hash of the
text. A null ``doc_id`` sorts after all others. ``keyed`` turns this into
two long columns (``dk``, ``rid``) that are never null, so that no join or
order below it has to think of nulls, and keeps nothing but these and the
text: other columns of the input, whatever their names, cannot clash.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.plans.manifest import Store
from docstrata.session import ensure_checkpoint_dir

MAX_LONG = (1 << 63) - 1
#: Text bytes that a kernel holds at a time; each needs about 60 bytes of arrays.
CHUNK = 1 << 20
U64 = np.uint64
_libc = ctypes.CDLL(None)

#: The white space of all word rules here (0x20 and 0x09-0x0D).
WS = r"\x20\x09-\x0D"
WS_CHARS = "\t\n\x0b\x0c\r "


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dk, rid, text): the document key of the module docstring; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("dk"),
        F.xxhash64(text).alias("rid"),
        text.alias("text"),
    )


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the session, one for each call."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/docstrata-llm/{_scratch.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Written tables made inside are removed at the end: for results that are written before."""
    folder = f"scratch-{uuid.uuid4().hex}/"
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        Store(spark, ensure_checkpoint_dir(spark)).delete(f"{ensure_checkpoint_dir(spark).rstrip('/')}/docstrata-llm/{folder}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------
# Arrow batches


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts go to Python in batches of so many rows at most from now on (a setting of the session):
    a batch is held by the JVM and by the worker, on the way there and back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Gives memory that numpy and Arrow have freed back to the machine: workers live on after
    their task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):  # glibc
        _libc.malloc_trim(0)


def text_pieces(batch: pa.RecordBatch, col: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``limit`` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    offs = string_offsets(batch.column(col))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def string_offsets(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array (no nulls), one more than rows."""
    kind = np.int64 if arr.type in (pa.large_string(), pa.large_binary()) else np.int32
    if not len(arr):
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets from 0) of a string or binary array without nulls."""
    offs = string_offsets(arr)
    if not len(arr) or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), offs * 0
    return np.frombuffer(arr.buffers()[2], np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the byte ranges [start, end) of data."""
    lens = (ends - starts).astype(np.int64)
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    at = np.arange(offs[-1], dtype=np.int64) + np.repeat(starts - offs[:-1], lens)
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(data[at])]).cast(pa.binary())


# --------------------------------------------------------------------------
# Hash kernels: polynomial hashes of byte ranges by prefix sums, modulo 2**64

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; grown by doubling and kept."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            p = np.ones(size, U64)
            filled = 1
            while filled < size:
                step = U64(pow(base, filled, 1 << 64))
                p[filled: 2 * filled] = p[:filled] * step
                filled *= 2
            _powers[name] = p
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of h."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums for range_hash; data: bytes, or 64-bit hashes of tokens."""
    p, _ = _power(len(data) + 1)
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * p[: len(data)], out=c[1:])
    return c


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) from its prefix sums; depends on the content alone."""
    _, q = _power(len(c))
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U64))


def every_range_hash(c: np.ndarray, length: int) -> np.ndarray:
    """Hash of every range of one length (none if data is shorter)."""
    n = len(c) - length
    if n <= 0:
        return np.zeros(0, U64)
    _, q = _power(len(c))
    return mix((c[length:] - c[:n]) * q[:n] + U64(length))


# --------------------------------------------------------------------------
# Words

_IS_WS = np.zeros(256, bool)
_IS_WS[[ord(c) for c in WS_CHARS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def with_breaks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one line feed after each, and the new offsets."""
    n = len(offs) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    at = np.arange(len(data), dtype=np.int64) + np.repeat(np.arange(n), np.diff(offs))
    out[at] = data
    return out, offs + np.arange(n + 1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data (as with_breaks gives it)."""
    gap = _IS_WS[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[:-rest], v[rest:]) if rest else v
