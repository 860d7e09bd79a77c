"""Training corpus from raw documents: five stages, each one operator of
``docstrata.llm`` over all that the stage before kept.

1. ``language``: texts whose language model rejects them, or without letters, go.
2. ``exact_dedup``: of equal texts (white space aside) one row stays.
3. ``near_dedup``: of each group linked by 80% of five-word shingles one document stays.
4. ``mix``: sources are mixed to target weights; a document comes as often as
   the mix takes it, each time with its whole text, in training order; all but
   the last stage keep the columns.
5. ``pack``: token sequences of the mixed rows.

A stage's result is written to the shared folder as Parquet and read again, so
that lineage ends there and a lost executor costs one stage at most. Stages set
the session's Arrow batches to 1024 rows: whole texts are in them. Rows with
a null id pass the first four stages like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm import common, exact, langid, minhash, mixing, packing
from docstrata.plans.manifest import Store

#: Shingle length of the near-duplicate stage.
SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return exact.without_copies(docs, file_backed=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return minhash.without_near_copies(docs, words=SHINGLE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return mixing.mixed_documents(docs, whole=True, file_backed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.packed(docs)


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Tokens and language models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables and its input are removed when its result is written."""
    docs = common.documents(spark, sf_dir)
    before = None
    for name, stage in STAGES:
        path = common.stage_path(spark, f"pipeline-{name}")
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            Store(spark, before).delete(before)
        docs, before = spark.read.parquet(path), path
    return docs
