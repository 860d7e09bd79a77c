"""Skew-safe ranking helpers.

``top_k``: exact top-k per group in two phases. Rows are first ranked
inside (group, salt) buckets, where the salt is a hash of a unique row
key, and only the best k of each bucket survive; the final window then
sees at most ``buckets * k`` rows per group. A group holding a third of
all rows is therefore spread over ``buckets`` tasks instead of one.

``rank_within``: dense position of every row of a group by an order, as
(number of rows with a better key) + (number with the same key and a smaller
first tie) + row_number inside the rows sharing both; the first two are
running sums in bounded ranges and chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import counted, cumulative, running

DEFAULT_BUCKETS = 64


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, unique: list[str],
          rank_col: str = "rank", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Rows of rank 1..k per ``group`` by ``order`` (which must end with
    unique columns so that the order is total)."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k).drop("_salt", "_r")


def rank_within(df: DataFrame, group: list[str], key: str, descending: bool, tie: list[str],
                rank_col: str = "rank") -> DataFrame:
    """Full 1..n ranking of each group by ``key`` (then ``tie``, whose first
    column is an integer >= 0 such as the page).

    Rows before = rows of better keys (a running sum over the ranges of the
    distinct keys) + rows of the same key on smaller first ties
    (``scan.running``) + the row number inside (key, first tie). No window
    runs over a whole group."""
    first = tie[0]
    signed = -F.col(key) if descending else F.col(key)
    rows = df.withColumn("_k", signed)
    per_key = cumulative(counted(rows, group, "_k"), group).select(*group, F.col("v").alias("_k"), (F.col("le") - F.col("c")).alias("_better"))
    pairs = rows.groupBy(*group, "_k", first).agg(F.count(F.lit(1)).alias("_n"))
    earlier = running(pairs, [*group, "_k"], first, "_n", "_earlier")
    wt = Window.partitionBy(*group, "_k", first).orderBy(*tie[1:] or tie)
    out = rows.withColumn("_t", F.row_number().over(wt)).join(earlier, [*group, "_k", first]).join(per_key, [*group, "_k"])
    return out.withColumn(rank_col, (F.col("_better") + F.col("_earlier") + F.col("_t")).cast("int")).drop("_k", "_t", "_better", "_earlier")
