"""SNK1, SNK2, SNK3, SNK5: writers for blocks, outlines, answers and the
bad-record table. All are distributed writes (no driver collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .tables import BLOCK_FIELDS, block_elements


def write_blocks(blocks: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64) -> None:
    """SNK1: block records in ``buckets`` folders by a hash of doc_id, so that
    one document's blocks land in one folder. Rows are rebalanced: a large
    folder is written by as many tasks as its size needs; ``fmt='json'`` writes one
    JSON array per document (the reference's file-per-document form)."""
    if fmt == "json":
        per_doc = blocks.groupBy("doc_id").agg(
            F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("page", "y0", "block_seq", F.struct(
                *schemas.BLOCK_COLUMNS).alias("b")))), lambda x: x["b"])).alias("value"))
        per_doc.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "value").alias("value")).write.mode(
            "overwrite").text(path)
        return
    (blocks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
     .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path))


def write_outlines(outlines: DataFrame, path: str) -> None:
    """SNK2: one JSON object per document (title, outline), non-ASCII kept."""
    outlines.write.mode("overwrite").json(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """SNK3: one answer object per request."""
    answers.write.mode("overwrite").json(path)


def bad_records(parsed: DataFrame, stage: str, fields: dict[str, str] | None = None) -> DataFrame:
    """SNK5: what could not be read, with its reason: (doc_key, stage, block_seq,
    field, error). A file without an array is one row (block_seq and field
    null), an element that is no object one (field null), and so is each
    field that holds no value of its type."""
    files = parsed.filter(F.col("error").isNotNull()).select(
        "doc_key", F.lit(None).cast("int").alias("block_seq"), F.lit(None).cast("string").alias("field"), "error")
    elements = block_elements(parsed.filter(F.col("error").isNull()), fields or BLOCK_FIELDS)
    no_object = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("element is no object").alias("error")))
    each = elements.select("doc_key", "block_seq", F.explode(F.when(F.col("is_object"), F.col("bad")).otherwise(no_object)).alias("b"))
    rows = files.unionByName(each.select("doc_key", "block_seq", "b.field", "b.error"))
    return rows.select("doc_key", F.lit(stage).alias("stage"), "block_seq", "field", "error")
