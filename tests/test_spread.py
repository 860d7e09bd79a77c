"""Inputs of few row groups are spread, well split ones are left as they are."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docstrata.sources.tables import spread


def _rows_by_partition(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_one_row_group_cut_by_bytes_is_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    n = 40_000
    rows = pa.table({"doc_id": pa.array(range(n)), "text": [f"{i:05d}" * 200 for i in range(n)]})
    pq.write_table(rows, tmp_path / "one.parquet", compression="none", use_dictionary=False)
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert df.rdd.getNumPartitions() >= cores  # by bytes; all rows are in one of them
        counts = _rows_by_partition(spread(df, "doc_id"))
        assert sum(counts) == n
        assert max(counts) <= 2 * n / cores
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])


def test_even_input_is_left_and_empty_input_passes(spark):
    cores = spark.sparkContext.defaultParallelism
    even = spark.range(0, 1000, 1, 2 * cores)
    assert spread(even, "id") is even
    assert spread(even.where("id < 0"), "id").count() == 0
