"""Streaming outlines over span files; a small model fit."""

import tempfile

from docstrata.sources import fixtures
from tests.conftest import SF_SMALL


def test_outline_stream(spark):
    from docstrata.streaming.outlines import outline_stream

    base = tempfile.mkdtemp(prefix="docstrata-stream-")
    spans = fixtures.fx_spans(spark, SF_SMALL).drop("lang")
    spans.repartition(3, "doc_id").write.parquet(f"{base}/in")
    q = outline_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == spans.select("doc_id").distinct().count()


def test_small_model_fit(spark):
    from docstrata.operators import model as M
    from docstrata.plans.pipeline import Corpus

    c = Corpus.from_fixtures(spark, SF_SMALL, with_requests=False)
    lab = M.weak_labels(c.scored)
    model, test = M.fit_structure_model(lab, title_params=dict(maxIter=3, maxDepth=3),
                                        heading_params=dict(numTrees=3, maxDepth=4))
    acc = M.accuracy(model, test).first()
    assert acc["n_test"] > 0 and 0.0 <= acc["heading_accuracy"] <= 1.0
    heads = M.predict_headings(model, c.scored, c.titles)
    assert set(r["level"] for r in heads.select("level").distinct().collect()) <= {"H1", "H2", "H3", "H4"}
    top = M.top_features(model, 5).collect()
    assert len(top) == 5


def test_rows_of_a_fit_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from docstrata.operators import model as M

    # as the window of the sample leaves them: all in one partition
    rows = spark.range(8000).select("id", (F.col("id") % 50).alias("doc_id"), (F.col("id") % 7).cast("int").alias("page"),
                                    F.col("id").cast("double").alias("first_y0"), F.col("id").cast("int").alias("first_seq")).coalesce(1)
    parts = spark.sparkContext.defaultParallelism
    out = M.dealt(rows)
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(counts) == parts and sum(counts) == 8000 and max(counts) < 1.2 * 8000 / parts
    ids = [r["id"] for r in out.collect()]
    assert ids == [r["id"] for r in M.dealt(rows.orderBy(F.desc("id")).coalesce(1)).collect()]
