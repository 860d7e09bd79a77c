"""Connected components of an edge table by alternating star operations.

Large-star hangs a node's larger neighbours on its least neighbour, small-star
the node and its smaller ones; both keep the components and end in stars
around the least node. Every round is a partial aggregation and a join, written
to the shared folder; no component, however large, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    hung = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return hung.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    hung = down.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node with an edge (u, v) to another."""
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        # a fixed point of both operations: stars around the least nodes
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    hubs = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        hubs.select(F.col("v").alias("node"), F.col("v").alias("component")))
