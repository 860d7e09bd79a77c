"""A dictionary of string keys: dense numbers in key order, by range prefix sums.

Distinct keys are range-sorted; a key's number is the count of keys in the
ranges before plus its place in its own. Only one count per range meets in a
window, and names are kept to the end, so that answers carry them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id: the row's place in its partition has this many bits.
PLACE_BITS = 33


def key_dictionary(names: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """(key, id): every distinct non-null key once, ids 0, 1, 2, ... in key order."""
    from ..plans.pipeline import write_stage

    rows = names.filter(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    at = F.monotonically_increasing_id()
    rows = write_stage(rows.select(key, F.shiftright(at, PLACE_BITS).alias("_part"), at.bitwiseAND((1 << PLACE_BITS) - 1).alias("_at")))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").select(key, (F.col("_before") + F.col("_at")).alias(id_col))


def with_ids(df: DataFrame, dictionary: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """df with the number of its key; rows whose key is not in the dictionary go."""
    return df.join(dictionary.select(key, id_col), key)
