"""One call from block files and request files to answers, resumable.

Stages: ``blocks`` (typed blocks, bad records, the dictionary of file names),
``outlines`` (titles, headings, classified groups), ``answers``. Each is
published under the fingerprint of what it was made from (``manifest``), so a
run that was stopped goes on where it stopped. Names are strings to the user
and dense numbers inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structure as S
from ..operators.keys import key_dictionary, with_ids
from ..sources import sinks, tables
from .manifest import Run, file_fingerprint
from .pipeline import Corpus


def read_stage(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed blocks by number, the dictionary of all files, and what could not be read.

    Rows without a text are no blocks; a block without a size or place on the
    page has 0 there."""
    from .pipeline import write_stage

    parsed = write_stage(tables.block_files(tables.json_files(spark, folder)))
    keys = write_stage(key_dictionary(parsed, "doc_key"))
    blocks = with_ids(tables.explode_block_files(parsed), keys, "doc_key")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_font_size", "y_position_relative")}
    blocks = blocks.filter(F.col("text").isNotNull()).withColumns({**zero, "page": F.coalesce("page", F.lit(1)), "y0": F.col("block_seq").cast("double")})
    return {"blocks": blocks, "keys": keys, "bad": sinks.bad_records(parsed, "blocks")}


def outline_stage(read: dict[str, DataFrame], model=None) -> dict[str, DataFrame]:
    """Outlines of the documents whose file was read, by name (D4), and what stage three needs."""
    failed = read["bad"].filter(F.col("block_seq").isNull()).select("doc_key").distinct()
    docs = read["keys"].join(failed, "doc_key", "left_anti")
    c = Corpus.from_blocks(read["blocks"], docs, model=model)
    classified = c.classified  # written once; the headings are read off it
    outlines = c.outlines.join(docs, "doc_id").select("doc_key", "title", "outline")
    return {"docs": docs, "outlines": outlines, "headings": c.headings, "classified": classified, "titles": c.titles}


def answer_stage(spark: SparkSession, outline: dict[str, DataFrame], requests: DataFrame, timestamp: str) -> dict[str, DataFrame]:
    reqs, request_docs = tables.requests_from_file(requests)
    c = Corpus.from_blocks(None, outline["docs"], requests=reqs, request_docs=request_docs,
                           headings=outline["headings"], classified=outline["classified"], titles=outline["titles"])
    return {"answers": c.answers(timestamp)}


def evaluation(read: dict[str, DataFrame], outline: dict[str, DataFrame]) -> DataFrame:
    """ML11 / A10 over all files: those that could not be read count as files without title and outline."""
    o = read["keys"].join(outline["outlines"], "doc_key", "left")
    return o.agg(F.count(F.lit(1)).alias("n_docs"), F.avg((F.coalesce("title", F.lit("")) != "").cast("double")).alias("title_rate"),
                 F.avg((F.coalesce(F.size("outline"), F.lit(0)) > 0).cast("double")).alias("heading_rate"))


def process(spark: SparkSession, block_folder: str, request_path: str, root: str, timestamp: str = "1970-01-01T00:00:00",
            run_id: str | None = None, model=None) -> tuple[DataFrame, Run]:
    """The answers to the requests in a file (or a folder of them) over a folder of
    block files, and the run. ``root`` keeps the stages."""
    run = Run(spark, root, run_id)
    read, mark = run.stage("blocks", file_fingerprint(spark, block_folder, "*.json"), lambda: read_stage(spark, block_folder))
    outline, mark = run.stage("outlines", f"{mark} {'rules' if model is None else model.name}", lambda: outline_stage(read, model))
    asked = file_fingerprint(spark, request_path)
    out, _ = run.stage("answers", f"{mark} {asked} {timestamp}", lambda: answer_stage(spark, outline, tables.request_file(spark, request_path), timestamp))
    run.finish()
    return out["answers"], run


def outline_headings(outlines: DataFrame) -> DataFrame:
    """SRC9: outlines that were written (``doc_key, title, outline``), read back as heading
    rows; a heading's place in the outline stands for its place on the page."""
    rows = outlines.select("doc_key", F.posexplode("outline").alias("pos", "o"))
    return rows.select("doc_key", F.col("o.page").cast("int").alias("page"), F.col("pos").cast("double").alias("first_y0"),
                       F.col("pos").alias("first_seq"), F.col("o.text").alias("text"), F.col("o.level").alias("level"),
                       F.col("o.confidence").cast("double").alias("confidence"))
