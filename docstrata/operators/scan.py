"""Running values and order statistics of a key without a window over the key.

``running`` is a segmented scan in levels: rows of a key are numbered by a
non-negative integer order (a page, say); windows run inside chunks of
``CHUNK`` orders, over the totals of ``CHUNK`` chunks, and over the totals of
those. Each window has a bounded number of rows however many a key has.

``cumulative`` and ``percentiles`` work on values, whose spread is not known
beforehand. Of a key with more than ``SMALL`` distinct values, these and their
counts are cut into ranges at splitters of a quantile sketch (a partial
aggregate of bounded size); a window runs over the totals of the ranges and, for
ranks, only the range that holds the rank is sorted. The sketch decides the
balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of a chunk, and chunks of a chunk of chunks.
CHUNK = 1 << 10
#: Ranges that the distinct values of a key are cut into.
RANGES = 64
#: Distinct values of a key up to which one aggregation buffer takes them all.
SMALL = 1 << 12


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str, how: str = "sum", chunk: int = CHUNK) -> DataFrame:
    """One row per (keys, order): (keys, order, out), the sum (0 at first) or the
    greatest value (null at first) of all smaller orders of the key. ``how``: sum or max."""
    agg = {"sum": F.sum, "max": F.max}[how]

    def both(a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if how == "sum" else F.greatest(a, b)

    low = F.floor(F.col(order) / F.lit(chunk)).cast("long")
    rows = df.groupBy(*keys, order).agg(agg(value).alias("_v")).withColumn("_c1", low)
    inner = rows
    # level by level: the totals of a chunk are the rows of the next level
    levels = []
    for k in (1, 2):
        here, above = f"_c{k}", f"_c{k + 1}"
        totals = inner.groupBy(*keys, here).agg(agg("_v").alias("_v")).withColumn(above, F.floor(F.col(here) / F.lit(chunk)).cast("long"))
        levels.append((here, totals))
        inner = totals
    done: DataFrame | None = None
    for here, totals in reversed(levels):
        above = f"_c{int(here[2:]) + 1}"
        part = [*keys] if done is None else [*keys, above]
        w = Window.partitionBy(*part).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        level = totals.withColumn("_p", agg("_v").over(w))
        if done is not None:
            level = level.join(done, [*keys, above], "left").withColumn("_p", both(F.col("_p"), F.col("_o")))
        done = level.select(*keys, here, F.col("_p").alias("_o"))
    w = Window.partitionBy(*keys, "_c1").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_p", agg("_v").over(w)).join(done, [*keys, "_c1"], "left")
    return rows.select(*keys, order, both(F.col("_p"), F.col("_o")).alias(out))


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c): the distinct non-null values of a key and their counts."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _sizes(dist: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """(keys, n, cuts): rows and splitters of each key."""
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return dist.groupBy(*keys).agg(F.sum("c").alias("n"),
                                   F.array_distinct(F.percentile_approx("v", at, F.lit(16 * ranges))).alias("cuts"))


def _ranged(dist: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """dist with its sizes and the number of the range, the splitters below the value."""
    r = F.size(F.filter("cuts", lambda x: x < F.col("v")))
    return dist.join(sizes, keys).withColumn("r", r).drop("cuts")


def _offsets(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, lo, total): rows before each range, and in it."""
    totals = ranged.groupBy(*keys, "r").agg(F.sum("c").alias("total"))
    w = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return totals.withColumn("lo", F.coalesce(F.sum("total").over(w), F.lit(0)))


def _large(dist: DataFrame, keys: list[str], small: int) -> DataFrame:
    """The keys of more than ``small`` distinct values; as a rule there are few or none."""
    return dist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd")).filter(F.col("_nd") > small).select(*keys)


def cumulative(dist: DataFrame, keys: list[str], small: int = SMALL, ranges: int = RANGES, keep: list[str] | None = None) -> DataFrame:
    """(keys, v, c, le, n) of rows (keys, v, c) with distinct v, and their columns ``keep``:
    rows of the key up to v, and all of them. Keys of up to ``small`` values are a window each."""
    from ..plans.pipeline import write_stage

    cols = [*keys, "v", "c", *(keep or [])]
    dist = write_stage(dist.select(*cols))  # read several times below
    large = _large(dist, keys, small)
    all_ = Window.partitionBy(*keys)
    none = large.isEmpty()
    few = (dist if none else dist.join(large, keys, "left_anti")).select(*cols, F.sum("c").over(all_.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("le"))
    few = few.withColumn("n", F.sum("c").over(all_))
    if none:
        return few
    many = dist.join(large, keys, "left_semi")
    ranged = _ranged(many, _sizes(many, keys, ranges), keys)
    w = Window.partitionBy(*keys, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_w", F.sum("c").over(w)).join(_offsets(ranged, keys).drop("total"), [*keys, "r"])
    return few.unionByName(out.select(*cols, (F.col("lo") + F.col("_w")).alias("le"), "n"))


def percentiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], small: int = SMALL, ranges: int = RANGES) -> DataFrame:
    """(keys, pct): exact percentiles of the values of a key, interpolated linearly.

    Keys of up to ``small`` distinct values are one aggregation buffer each;
    for the others the values at the ranks are selected by ranges."""
    from ..plans.pipeline import write_stage

    return percentiles_of(write_stage(counted(df, keys, value)), keys, probabilities, small, ranges)


def percentiles_of(dist: DataFrame, keys: list[str], probabilities: list[float], small: int = SMALL, ranges: int = RANGES) -> DataFrame:
    """``percentiles`` from a written table of distinct values and counts."""
    large = _large(dist, keys, small)
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    none = large.isEmpty()
    few = (dist if none else dist.join(large, keys, "left_anti")).groupBy(*keys).agg(F.percentile("v", ps, F.col("c")).alias("pct"))
    if none:
        return few
    many = dist.join(large, keys, "left_semi")
    ranged = _ranged(many, _sizes(many, keys, ranges), keys)
    return few.unionByName(_selected(ranged, keys, probabilities))


def _selected(ranged: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    offsets = _offsets(ranged, keys)
    n = ranged.groupBy(*keys).agg(F.max("n").alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probabilities)])
    ranks = n.select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.i", "w.at", F.explode(F.array_distinct(
        F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    # the range of each rank, and of that range the values in order
    ranks = ranks.join(offsets, keys).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("total")))
    asked = ranks.select(*keys, "r", "lo").distinct()
    w = Window.partitionBy(*keys, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select(*keys, "r", "v", "c").join(asked, [*keys, "r"]).withColumn("upto", F.col("lo") + F.sum("c").over(w))
    hit = ranks.select(*keys, "r", "i", "at", "rank").join(inside.select(*keys, "r", "v", "c", "upto"), [*keys, "r"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    at = F.max("at")
    # the built-in's own interpolation, so that both give the same double
    each = hit.groupBy(*keys, "i").agg(
        F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("p"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("pct"))
