"""two text columns per document by exact 1-D 2-means on the block's x0.

The reference intends k-means with two clusters on x0 over all blocks of a
document before the merge (its code, as written, always yields 0; that
constant stays the default of the block stage). In one dimension the
optimal 2-means split is a cut of the sorted values: a document is reduced
to its distinct x0 with counts (partial aggregation), prefix sums over
these give the squared error of every cut, and the cut with the least
error wins (ties: the first). Documents with one distinct x0 are all 0.
Sums are taken of x0 less the document's least x0, so that large values
lose no digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SSE_DIGITS = 6


def column_cuts(blocks: DataFrame, x_col: str = "bx0") -> DataFrame:
    """(doc_id, cut_x): greatest x0 of the left column; documents with two distinct x0 or more."""
    hist = blocks.select("doc_id", F.col(x_col).cast("double").alias("x")).groupBy("doc_id", "x").agg(
        F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("doc_id")
    run = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("d", F.col("x") - F.min("x").over(whole))
    c, d = F.col("c"), F.col("d")
    for name, value in (("n", c), ("s", c * d), ("q", c * d * d)):
        h = h.withColumn(name, F.sum(value).over(run)).withColumn(f"{name}_all", F.sum(value).over(whole))
    rest = {k: F.col(f"{k}_all") - F.col(k) for k in ("n", "s", "q")}
    sse = F.col("q") - F.col("s") * F.col("s") / F.col("n") + rest["q"] - rest["s"] * rest["s"] / rest["n"]
    cuts = h.where(rest["n"] > 0).groupBy("doc_id").agg(F.min(F.struct(F.round(sse, SSE_DIGITS).alias("e"), "x")).alias("best"))
    return cuts.select("doc_id", F.col("best.x").alias("cut_x"))


def column_groups(blocks: DataFrame, x_col: str = "bx0") -> DataFrame:
    """Adds column_group (0 left, 1 right) to blocks before the merge."""
    x = F.col(x_col).cast("double")
    return blocks.join(column_cuts(blocks, x_col), "doc_id", "left").withColumn(
        "column_group", F.when(x > F.col("cut_x"), 1).otherwise(0)).drop("cut_x")
