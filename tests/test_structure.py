"""Stage 2 on hand-written documents: statistics ties, numbering levels,
title exclusion, invariants."""

from pyspark.sql import functions as F

from docstrata.operators import structure as S
from tests.conftest import block_rows


def test_body_font_mode_first_seen(spark):
    rows = [(1, 1, 0, "aaa", 10, False, 0.1, 0), (1, 1, 1, "bbb", 10, False, 0.5, 50),
            (1, 1, 2, "ccc", 12, False, 0.7, 50), (1, 1, 3, "ddd", 12, False, 0.9, 50)]
    st = S.doc_stats(S.prepare_blocks(block_rows(spark, rows))).first()
    assert st["most_common_font"] == 10.0
    assert st["total_items"] == 4
    assert abs(st["avg_spacing"] - 50.0) < 1e-12


def test_numbered_headings(spark):
    rows = [(1, 1, i, t, 12, False, 0.1 + 0.2 * i, 40) for i, t in
            enumerate(["1. Intro", "1.1 Background", "1.1.1 Deep", "12 Angry"])]
    st = S.structure(block_rows(spark, rows))
    lv = {r["text"]: r["level"] for r in st["scored"].select("text", S.heading_level().alias("level")).collect()}
    assert lv["1. Intro"] == "H2"
    assert lv["1.1 Background"] == "H3"
    assert lv["12 Angry"] == "H2"
    assert lv["1.1.1 Deep"] not in ("H2", "H3") or lv["1.1.1 Deep"] == "H3"


def test_title_and_running_header_excluded(spark):
    rows = [(1, 1, 0, "Annual Report of the Big Company", 24, True, 0.05, 0),
            (1, 1, 1, "body text line one here", 11, False, 0.5, 40),
            (1, 2, 2, "Annual Report of the Big Company", 24, True, 0.05, 0),
            (1, 2, 3, "Results", 16, True, 0.3, 40)]
    st = S.structure(block_rows(spark, rows))
    title = st["titles"].first()["title"]
    assert title == "Annual Report of the Big Company"
    heads = S.rule_headings(st["scored"], st["titles"]).collect()
    assert all(h["text"] != title for h in heads)


def test_empty_document_gives_empty_title(spark):
    from docstrata.plans.pipeline import Corpus
    from docstrata import schemas

    spans = spark.createDataFrame([(7, 1, 0, 0, 0, "  ", "Helvetica", 11.0, 0, 0, 0.0, 0.0, 10.0, 10.0, 612.0, 792.0)],
                                  schemas.SPANS)
    c = Corpus(spans, materialize=False)
    out = c.outlines.collect()
    assert [(r["doc_id"], r["title"], len(r["outline"])) for r in out] == [(7, "", 0)]


def test_group_invariants_on_fixture(spark):
    from docstrata.plans.pipeline import Corpus
    from tests.conftest import SF_SMALL

    c = Corpus.from_fixtures(spark, SF_SMALL, with_requests=False)
    g = c.groups
    n_blocks = c.blocks.count()
    agg = g.agg(F.sum("group_size").alias("n"), F.min("group_size").alias("lo"), F.max("group_size").alias("hi")).first()
    assert agg["n"] == n_blocks  # every block in exactly one group
    assert 1 <= agg["lo"] and agg["hi"] <= 4
    long_multi = g.filter((F.col("group_size") > 1) & (F.length("text") > 300 + 3)).count()
    assert long_multi == 0
    titles = c.titles
    assert titles.count() == titles.select("doc_id").distinct().count()
