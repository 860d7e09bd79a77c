"""Embedding near-deduplication with randomised-rotation binary codes.

A vector, scaled to length one, is turned by a few random rotations; the
signs are its code, and for every rotation the inner product of the vector
with its own signs is stored as a correction factor. Sign products divided
by the factor estimate an inner product without bias, and its error has a
bound that falls with the dimension and the number of rotations.

Candidates come from bands of code bits inside a label: two vectors at the
threshold agree in a bit with probability 1 - angle / pi, so that bands of
``k`` bits are drawn until such a pair meets with probability ``RECALL``;
``k`` grows with the logarithm of the label's size, which keeps buckets at
about ``BUCKET`` vectors and the work near n log n. In a bucket a pair is
judged in the first band in which it meets: the confidence interval of its
estimate drops it or sends it to exact recomputation in double precision.
Links are counted there and only one edge per vector leaves the task, so
that pairs are never emitted. Equal vectors are one class with a number.

Scale. A bucket of more than ``BLOCK`` vectors is cut into blocks and dealt
out as pairs of blocks. Label sizes and classes are partial aggregations.

Edge rows: null labels, null or empty vectors, null or non-finite components
and zero vectors link with nothing; vectors of different lengths never link;
a null id sorts last and returns null; rows that share an id are one node;
a row given twice counts once; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import MAX_LONG, written
from docstrata.llm.components import components
from docstrata.llm.repeats import whole_groups

THRESHOLD = 0.93
RECALL = 0.995
BUCKET = 64
BLOCK = 2048
#: Half-width of a confidence interval in standard errors.
SIGMAS = 5.0
SEED = 11


def band_plan(k: int, threshold: float, recall: float) -> int:
    """Bands of k bits in which a pair at the threshold meets with probability ``recall``."""
    agree = (1 - math.acos(threshold) / math.pi) ** k
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int) -> np.ndarray:
    """Stacked random rotations (rows) of at least ``bits`` rows."""
    out = []
    for i in range(-(-bits // dim)):
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim, i])).standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(out)


def encode(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows x rotations * dim) and correction factors (rows x rotations) of unit vectors."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, bits).T
    factors = np.abs(turned).reshape(len(unit), -1, dim).sum(2) / math.sqrt(dim)
    return turned > 0, factors


def estimates(signs: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimate of each inner product (row: coded vector, column: query) and the standard error of a row."""
    n, dim = unit.shape
    m = factors.shape[1]
    turned = (unit @ rotations(dim, m * dim).T).reshape(n, m, dim)
    x = np.where(signs, 1.0, -1.0).reshape(n, m, dim) / (math.sqrt(dim) * m * factors[:, :, None])
    est = x.reshape(n, -1).astype(np.float32) @ turned.reshape(n, -1).astype(np.float32).T
    per = np.maximum(0.0, 1 - factors ** 2) / factors ** 2 / max(dim - 1, 1)
    return est, np.sqrt(per.sum(1)) / m


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim, emb (bytes of floats; null for vectors that link with nothing)."""
    for b in batches:
        emb, dims = [], []
        for label, v in zip(b.column("label"), b.column("embedding")):
            x = None
            if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                x = np.asarray(v.values, np.float64)
                big = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x if big > 0 else None
            emb.append(None if x is None else x.tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(emb, pa.binary())],
                                         names=["vec_id", "label", "dim", "emb"])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _band_keys(signs: np.ndarray, k: int, bands: int) -> np.ndarray:
    weights = (1 << np.arange(k, dtype=np.int64))
    return signs[:, : k * bands].reshape(len(signs), bands, k) @ weights


def _bands(threshold: float, recall: float, vectors: bool):
    """A row for each vector and band; with its vector, code and factors if ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ks = np.asarray(b.column("dim")), np.asarray(b.column("k"))
            for dim, k in sorted(set(zip(dims.tolist(), ks.tolist()))):
                at = np.flatnonzero((dims == dim) & (ks == k))
                bands = band_plan(k, threshold, recall)
                step = max(1, (1 << 22) // (bands * (8 * dim + 64)))
                for lo in range(0, len(at), step):
                    own = b.take(pa.array(at[lo: lo + step]))
                    signs, factors = encode(_unit(own.column("emb"), dim), k * bands)
                    keys = _band_keys(signs, k, bands)
                    n = own.num_rows
                    each = pa.array(np.repeat(np.arange(n), bands))
                    cols = [own.column("label").take(each), own.column("dim").take(each), own.column("k").take(each),
                            pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.ravel()), own.column("node").take(each)]
                    names = ["label", "dim", "k", "band", "key", "node"]
                    if vectors:
                        code = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                        fact = pa.array([r.tobytes() for r in factors.astype(np.float32)], pa.binary())
                        cols += [own.column("size").take(each), own.column("emb").take(each), code.take(each), fact.take(each)]
                        names += ["size", "emb", "code", "factors"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _local_hubs(n: int, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Least node of each row's component inside the bucket."""
    label = node.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if np.array_equal(new, label):
            return label
        label = new


def _judge(threshold: float, recall: float, sigmas: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["label", "dim", "k", "band", "key", "cell"]
        for table in whole_groups(batches, keys[1:], "emb"):
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for c in keys:
                x = np.asarray(table.column(c))
                change[1:] |= x[1:] != x[:-1]
            edges = np.append(np.flatnonzero(change), table.num_rows)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo < 2:
                    continue
                g = table.slice(lo, hi - lo).combine_chunks()
                out = _bucket(g, threshold, recall, sigmas)
                if out is not None:
                    yield out

    return run


def _bucket(g: pa.Table, threshold: float, recall: float, sigmas: float) -> pa.RecordBatch | None:
    dim, k, band = (g.column(c)[0].as_py() for c in ("dim", "k", "band"))
    node, size, part = (np.asarray(g.column(c)) for c in ("node", "size", "part"))
    unit = _unit(g.column("emb").combine_chunks(), dim)
    bands = band_plan(k, threshold, recall)
    factors = np.frombuffer(b"".join(g.column("factors").to_pylist()), np.float32).reshape(len(node), -1).astype(np.float64)
    signs = np.unpackbits(np.frombuffer(b"".join(g.column("code").to_pylist()), np.uint8).reshape(len(node), -1), axis=1)
    signs = signs[:, : factors.shape[1] * dim].astype(bool)
    keys = _band_keys(signs, k, bands)
    est, error = estimates(signs, factors, unit)
    near = (est + sigmas * error[:, None] >= threshold) & (est.T + sigmas * error[None, :] >= threshold)
    if part.min() != part.max():  # a cell of two blocks: pairs across only
        near &= part[:, None] != part[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    # a pair is judged in the first band where it meets, and never with its own node
    fresh = node[a] != node[b]
    for earlier in range(band):
        fresh &= keys[a, earlier] != keys[b, earlier]
    a, b = a[fresh], b[fresh]
    linked = np.concatenate([np.einsum("ij,ij->i", unit[a[i: i + 65536]], unit[b[i: i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= threshold
    a, b = a[linked], b[linked]
    if not len(a):
        return None
    links = np.bincount(a, weights=size[b], minlength=len(node)) + np.bincount(b, weights=size[a], minlength=len(node))
    hub = _local_hubs(len(node), a, b, node)
    own = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(links[own].astype(np.int64)), pa.array(hub[own])], names=["node", "links", "hub"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET,
                 block: int = BLOCK, sigmas: float = SIGMAS, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; see the module docstring."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_clean, "vec_id long, label string, dim int, emb binary")
                   .withColumn("dk", F.coalesce("vec_id", F.lit(MAX_LONG))), "vectors")
    good = rows.where("emb IS NOT NULL")
    classes = good.select("label", "dim", "emb", "dk").distinct().groupBy("label", "dim", "emb").agg(
        F.min("dk").alias("node"), F.count(F.lit(1)).alias("size"))
    classes = written(classes, "vector-classes")
    sizes = classes.groupBy(F.col("label").alias("l"), F.col("dim").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / bucket))).cast("int")).drop("n")
    sized = classes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d")
    schema = "label string, dim int, k int, band int, key long, node long"
    by = ["label", "dim", "band", "key"]
    crowd = sized.select("label", "dim", "k", "node", "emb").mapInArrow(_bands(threshold, recall, False), schema)
    crowd = crowd.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowd = crowd.select(*[F.col(c).alias(f"_{c}") for c in by], F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    banded = sized.mapInArrow(_bands(threshold, recall, True), f"{schema}, size long, emb binary, code binary, factors binary")
    match = [F.col(c) == F.col(f"_{c}") for c in by]
    banded = banded.join(crowd, match, "left").drop(*[f"_{c}" for c in by])
    blocks = F.coalesce("blocks", F.lit(1))
    banded = banded.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least("part", j) * blocks + F.greatest("part", j))
    banded = banded.withColumn("cell", F.explode(cell)).drop("blocks")
    order = ["label", "dim", "k", "band", "key", "cell"]
    judged = banded.repartition("label", "band", "key", "cell").sortWithinPartitions(*order).mapInArrow(
        _judge(threshold, recall, sigmas), "node long, links long, hub long")
    judged = written(judged, "vector-links")
    links = judged.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    comp = components(judged.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    per = classes.join(links, F.col("node") == F.col("n"), "left").drop("n")
    # classes that share a node id share its component
    per = per.join(comp.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.col("emb").alias("e"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.join(per, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("emb") == F.col("e")), "left")
    least = F.coalesce("c", "dk")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(least != MAX_LONG, least).alias("component_id"), (F.col("dk") == least).alias("kept"))


