"""Incremental outlines with Structured Streaming.

The reference lists an input folder once per run. Here a folder of span
files (D1, Parquet) is read as a file stream; every micro-batch runs the
batch stages on the new files and writes the outlines (D4) to a folder of
its own (``batch=<id>``), which a repeated batch overwrites.
Each file must hold whole documents (one file per document, as one PDF
per file in the reference), so a micro-batch never sees half a document.
The checkpoint location makes the job restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas


def outline_stream(spark: SparkSession, spans_dir: str, out_dir: str, checkpoint_location: str,
                   max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    from ..plans.pipeline import Corpus

    reader = spark.readStream.schema(schemas.SPANS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    spans = reader.parquet(spans_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        corpus = Corpus(batch, materialize=False)
        corpus.outlines.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch_id}")

    writer = spans.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
