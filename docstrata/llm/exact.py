"""Exact deduplication by stateful streaming.

Documents are equal when their texts are after white space is deleted. A
small fingerprint row (digest, id, length, content locator) per document is
written to the shared folder; Structured Streaming reads these files and
keeps, in RocksDB state keyed by the digest and without expiry, how often
the digest came, and the identifier and locator of the document that stays
(most code points, then smallest id). The state is read back as a table.
A digest that came more than once is a hit: the full normalised bytes of its
documents are fetched by locator and compared with those of the one that
stays. Should two texts share a digest, the odd ones are grouped by their
full text, so that the result never rests on the digest alone.

Scale. The stream shuffles fingerprints, pre-aggregated, never texts; state
is disk-backed and bounded in memory. Texts are shuffled only for hits: the
scan that fetches them drops the other rows by the bits of the hits' locators
(``bits``), and so does the scan that drops copies. A digest with very many
documents is salted: the text that stays is copied once for every
``SALT_ROWS`` documents.

Edge rows: null text counts as empty, and empty texts are equal; a null id
sorts last; rows that repeat are copies of each other, exactly one of which
stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.bits import bits_of, may_hold, without
from docstrata.llm.common import MAX_LONG, WS_CHARS, stage_path, written

#: Documents of a digest that are compared by one copy of the text that stays.
SALT_ROWS = 4096
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # commits upload what changed, and a store is closed with its task: open stores hold preallocated files
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: F.Column) -> F.Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in reversed(WS_CHARS):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


@contextmanager
def _state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _locator() -> F.Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _locator_hash(place: str) -> F.Column:
    return F.xxhash64(f"{place}.file", f"{place}.row")


def keyed_state(spark: SparkSession, prints_path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Streams the fingerprints into the state; returns it: key, n, best (rank, dk, at)."""
    at = stage_path(spark, "exact-state")
    with _state_settings(spark):
        stream = spark.readStream.schema(schema)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        state = stream.parquet(prints_path).groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "dk", "at")).alias("best"))
        query = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", at)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        rows = spark.read.format("statestore").load(at)
        value = rows.schema["value"].dataType.names
        return written(rows.select(F.col("key.key").alias("key"), F.col(f"value.{value[0]}").alias("n"),
                                   F.col(f"value.{value[1]}").alias("best")), "exact-groups")


def located(docs: DataFrame, file_backed: bool) -> DataFrame:
    """docs as a plain scan of files, whose rows have a place; written first unless it is one."""
    if file_backed:
        try:
            docs.select(_locator())
            return docs
        except AnalysisException:  # no scan after all: its rows have no place
            pass
    return written(docs, "exact-input")


def exact_groups(docs: DataFrame, file_backed: bool = False, digest_bytes: int = 32,
                 files_per_batch: int | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, at (locator).

    ``file_backed``: docs is an unjoined scan of files. ``digest_bytes``
    shortens the state's key (results stay the same).
    """
    spark = docs.sparkSession
    docs = located(docs, file_backed)
    norm = normalised(F.col("text"))
    prints_path = stage_path(spark, "exact-prints")
    sha = F.sha2(norm, 256)
    prints = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _locator().alias("at"), sha.alias("text_sha256"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("length"))
    prints = prints.select(
        "doc_id", "at", "text_sha256", F.expr(f"substring(unhex(text_sha256), 1, {digest_bytes})").alias("key"),
        (-F.col("length")).alias("rank"), F.coalesce("doc_id", F.lit(MAX_LONG)).alias("dk"))
    prints.write.parquet(prints_path)
    schema = prints.schema
    prints = spark.read.schema(schema).parquet(prints_path)
    state = keyed_state(spark, prints_path, schema, files_per_batch)

    alone = prints.join(state.where("n = 1").select("key"), "key").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "at")

    copies = F.ceil(F.col("n") / F.lit(salt_rows)).cast("int")
    hits = prints.join(state.where("n > 1").withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k")
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("at"), copies).cast("int")).withColumn("first", F.col("at") == F.col("best.at"))
    hits = written(hits, "exact-hits")
    found = bits_of(hits.select(_locator_hash("at").alias("h")))
    texts = docs.select(_locator().alias("place"), "text").where(may_hold(found, _locator_hash("place"))).select("place", norm.alias("norm"))
    fetched = written(texts.join(hits, F.col("place") == F.col("at")).drop("place"), "exact-texts")
    stays = fetched.where("first").select(
        F.col("key").alias("k"), F.col("norm").alias("full"),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("s"))
    checked = fetched.join(stays, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")))
    # null for the texts that equal the one that stays, else the text itself
    checked = checked.select("doc_id", "at", "text_sha256", "key", "rank", "dk", F.when(F.col("norm") != F.col("full"), F.col("norm")).alias("other"))
    groups = checked.groupBy("key", "other").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct("rank", "dk", "at", "doc_id")).alias("best"))
    groups = groups.withColumnRenamed("key", "k").withColumnRenamed("other", "o")
    many = checked.join(groups, (F.col("key") == F.col("k")) & F.col("other").eqNullSafe(F.col("o"))).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("best.at")).alias("kept"), "text_sha256", "at")
    return alone.unionByName(many)


def without_copies(docs: DataFrame, file_backed: bool = False) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    docs = located(docs, file_backed)
    gone = exact_groups(docs, file_backed=True).where(~F.col("kept")).select("at.file", F.col("at.row").alias("place"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("place"))
    return without(rows, ["file", "place"], gone).select("row.*")


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
