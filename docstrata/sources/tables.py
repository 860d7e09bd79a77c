"""Scans of the input tables and of block / outline / request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


#: Times the mean share of a core that the largest partition of a well split input holds.
EVEN = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet scan, so projections and filters written
    after it reach the reader (ReadSchema / PushedFilters)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-spread an input whose rows lie in fewer partitions than the
    cluster has cores; inputs that are well split are left as they are.

    A Parquet file is cut by bytes, but a row group is read by one task, so
    that of many partitions all but one may be empty: the rows of each are
    counted (from the footers, no column is read)."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a Connect session): leave as is
        return df
    if parts >= cores:
        each = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = each.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * cores <= EVEN * rows:
            return df
    n = max(cores, parts)
    return df.repartition(n, *cols) if cols else df.repartition(n)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC1: files of a folder whose lower-case name ends in ``.pdf``.

    Only the listing and sizes are read here (``content`` is pruned unless
    selected); decoding PDF bytes is not part of this engine."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .load(folder)
        .select("path", "length", "modificationTime")
    )


#: Fields of a block record that the structure stage reads, with their types.
BLOCK_FIELDS = {
    "page": "int", "text": "string", "avg_font_size": "double", "font_name": "string", "is_bold": "boolean", "is_italic": "boolean",
    "is_center_aligned": "boolean", "caps_ratio": "double", "indentation_ratio": "double", "y_position_relative": "double",
    "spacing_above": "double",
}
#: Characters of an unreadable file that its bad record quotes.
QUOTED = 40


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_key, value): each ``*.json`` file whole; the key is its URL-decoded name without extension."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    return raw.select(F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]+)\.json$", 1).alias("doc_key"), "value")


def block_files(files: DataFrame) -> DataFrame:
    """SRC5 / SRC6: (doc_key, blocks, error) of rows (doc_key, value), one file each.

    A file holds one JSON array; ``blocks`` is it as VARIANT, read without a
    schema, so that one odd value costs no more than itself. ``error`` says
    what is wrong with a file that holds none."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    error = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty file")
        .when(v.isNull(), F.concat(F.lit("malformed JSON: "), F.substring("value", 1, QUOTED)))
        .when(~kind.startswith("ARRAY"), F.concat(F.lit("no array but "), F.regexp_extract(kind, r"^\w+", 0)))
    )
    return files.select("doc_key", F.when(error.isNull(), v).alias("blocks"), error.alias("error"))


def block_elements(parsed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(doc_key, block_seq, is_object, typed, bad): each element of the arrays; ``typed`` its
    fields by type, ``bad`` those that are there but are no value of their type."""
    rows = parsed.sparkSession.sql(
        "SELECT p.doc_key, e.pos AS block_seq, e.value AS v FROM {p} p, LATERAL variant_explode(p.blocks) e", p=parsed)
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    typed = F.struct(*[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in fields.items()])
    rows = rows.select("doc_key", "block_seq", "v", is_object.alias("is_object"), F.when(is_object, typed).alias("typed"))

    def wrong(name: str, kind: str) -> Column:
        found = F.try_variant_get("v", f"$.{name}", "variant")
        there = found.isNotNull() & ~F.is_variant_null(found)
        return F.when(there & F.col("typed")[name].isNull(), F.struct(
            F.lit(name).alias("field"),
            F.concat(F.regexp_extract(F.schema_of_variant(found), r"^\w+", 0), F.lit(f" is no {kind}")).alias("error")))

    bad = F.array_compact(F.array(*[wrong(n, k) for n, k in fields.items()]))
    return rows.select("doc_key", "block_seq", "is_object", "typed", F.when(F.col("is_object"), bad).alias("bad"))


def explode_block_files(parsed: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """SRC6: one row per block of the non-empty arrays with its position; a
    field that cannot be read is null, an element that is no object no block."""
    return block_elements(parsed, fields or BLOCK_FIELDS).filter("is_object").select("doc_key", "block_seq", "typed.*")


def unite(*sources: DataFrame) -> DataFrame:
    """Sources of blocks as one; a column that one of them lacks is null there."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def request_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC7 / SRC8: request objects (D5), one a file, with the file's path; unreadable -> corrupt record."""
    schema = T.StructType([*schemas.REQUEST.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return rows.withColumn("path", F.col("_metadata.file_path"))


def requests_from_file(df: DataFrame, request_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Turn request objects (D5) into the ``requests`` / ``request_docs`` pair; files
    are numbered from ``request_id`` on in order of their paths."""
    from ..operators.keys import key_dictionary

    numbers = key_dictionary(df.filter(F.col("documents").isNotNull()), "path", "number")
    reqs = df.filter(F.col("documents").isNotNull()).join(numbers, "path").select(
        (F.col("number") + request_id).cast("long").alias("request_id"),
        F.col("persona.role").alias("persona"),
        F.col("job_to_be_done.task").alias("task"),
        "documents",
    )
    docs = reqs.select(
        "request_id", F.posexplode("documents").alias("pos", "d")
    ).select(
        "request_id",
        F.col("d.filename").alias("filename"),
        (F.col("pos") + 1).alias("doc_pos"),
    )
    return reqs.drop("documents"), docs
