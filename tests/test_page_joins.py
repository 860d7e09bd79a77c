"""Statistics of a document meet its blocks and groups by page: no wide row is shuffled for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata import schemas
from docstrata.functions.text import word_count
from docstrata.operators import blocks as B
from docstrata.operators import model as M
from docstrata.operators import structure as S
from docstrata.plans.pipeline import Corpus, write_stage

WORDS = ["alpha", "Beta", "1. Intro", "gamma delta", "Page 3", "The End:", "x" * 210, "a  b", "über uns"]


@pytest.fixture
def spans(spark, tmp_path):
    rng = random.Random(3)
    rows = [(d, rng.choice([1, 2, None]), b, 0, s, rng.choice(WORDS), rng.choice(["Arial", "Times-Bold"]), rng.choice([9.0, 11.0, 16.5, 20.0]),
             0, 0, 0.0, 56.0 * b, 10.0, 56.0 * b + 40, 612.0, 792.0) for d in [*range(8), None] for b in range(9) for s in range(2)]
    spark.createDataFrame(rows, schemas.SPANS).write.parquet(str(tmp_path / "spans"))
    return spark.read.parquet(str(tmp_path / "spans"))


def _above(df, node):
    """The operators above each ``node`` of the physical plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [(len(re.match(r"[\s:|+\-*]*(?:\(\d+\) )?", x).group().rstrip("*(0123456789) ")), x) for x in lines]
    out = []
    for i, (depth, line) in enumerate(at):
        if node in line:
            for up, text in reversed(at[:i]):
                if up < depth:
                    depth = up
                    out.append(text)
    assert out
    return out


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_blocks_and_groups_are_not_shuffled_for_the_statistics(spans, no_broadcast):
    blocks = B.blocks_from_spans(spans)
    assert not [x for x in _above(blocks, "Generate explode") if "Exchange" in x]
    scored = S.structure(write_stage(blocks))["scored"]
    assert not [x for x in _above(scored, "Generate posexplode") if "Exchange" in x]


def test_rows_without_page_have_the_statistics_of_their_document(spans):
    blocks = write_stage(B.blocks_from_spans(spans))
    assert blocks.schema["page"].dataType == spans.schema["page"].dataType
    stats = B.span_doc_stats(spans)
    got = blocks.filter("doc_id IS NOT NULL").join(stats, "doc_id")
    assert blocks.filter("page IS NULL").count() > 8
    assert got.filter(~F.col("font_size_diff").eqNullSafe(F.col("avg_font_size") - F.col("median_font_size"))).isEmpty()
    assert blocks.filter("doc_id IS NULL AND (font_size_diff IS NOT NULL OR font_diff_from_body IS NOT NULL)").isEmpty()
    st = S.structure(blocks)
    want = S.with_doc_stats(st["groups"], st["stats"]).select("doc_id", "page", "first_seq", "text", "font_p95", "doc_avg_spacing")
    assert st["scored"].select(*want.columns).exceptAll(want).isEmpty() and want.exceptAll(st["scored"].select(*want.columns)).isEmpty()


def test_percentiles_of_few_sizes_are_those_of_many(spans, monkeypatch):
    blocks = write_stage(B.blocks_from_spans(spans))
    take = lambda: S.structure(blocks)["scored"].select("doc_id", "page", "first_seq", "font_percentile")
    few = write_stage(take())
    monkeypatch.setattr(S, "FEW_SIZES", 3)
    many = write_stage(take())
    assert few.count() > 20
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_rule_headings_are_the_headings_of_all_groups(spans):
    c = Corpus(spans)
    cols = ["doc_id", "page", "first_y0", "first_seq", "text", "level"]
    got = c.headings.select(*cols)
    assert "classified" not in c.__dict__  # the whole table of groups is not written for them
    want = c.classified.filter("is_heading").select(*cols)
    assert got.count() > 5
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_labels_are_made_once_for_their_index(spans, tmp_path):
    path = str(tmp_path / "labels")
    spans.select(F.col("font").alias("heading_label")).write.parquet(path)
    out = M.label_index(spans.sparkSession.read.parquet(path))
    assert not any(path in f for f in out.inputFiles())
    assert sorted(map(tuple, out.collect())) == [("Arial", 0.0), ("Times-Bold", 1.0)]


def test_word_count_of_plain_and_odd_texts(spark):
    texts = ["", " ", "a", "a b", "a  b", " a b", "a b ", "a\tb c", "a b c", "a b", "a　b", "“a b” – c", "a\x85b c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        word_count(F.col("t")).alias("n"), F.regexp_count("t", F.lit(r"[^\s\p{Z}]+")).alias("want"))
    assert df.filter(~F.col("n").eqNullSafe(F.col("want"))).isEmpty()
    assert df.filter("n IS NOT NULL").count() == len(texts) - 1
