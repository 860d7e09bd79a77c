"""Stage 3: fallbacks, ranking ties, the model hook and the answer shape."""

import pandas as pd
from pyspark.sql import functions as F

from docstrata.operators import requests as R


def test_fallback_sections_by_name(spark):
    names = ["South of France - Cities.pdf", "Things to Do.pdf", "cuisine.pdf", "Tips and Tricks.pdf", "History.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    got = [tuple(r[0]) for r in df.select(R.fallback_section(F.col("filename"))).collect()]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5]
    assert got[0][0] == "Major Cities Guide" and got[4][0] == "General Information"


def test_parse_model_sections(spark):
    df = spark.createDataFrame([
        ('Here: [{"section_title": "A", "importance_rank": 1, "page_number": 2}] done',),
        ('x [{"a":[1,2]}] y',),
        ("no array",),
        ("[]",),
        ('["a", {"section_title": "B", "importance_rank": "2", "page_number": 1}, 3]',),
    ], "r string")
    got = [r[0] for r in df.select(R.parse_model_sections(F.col("r"))).collect()]
    assert got[0][0]["section_title"] == "A"
    assert got[1] is None  # cut at the first ']': no valid JSON
    assert got[2] is None
    assert got[3] == []
    assert [tuple(x) for x in got[4]] == [("B", 2, 1)]  # the object alone, its rank as a number


def test_rank_ties_follow_request_order(spark):
    cand = spark.createDataFrame([
        (1, 10, "b.pdf", 2, "B1", 1, 1, 1), (1, 11, "a.pdf", 1, "A1", 1, 1, 1), (1, 11, "a.pdf", 1, "A2", 2, 1, 2),
    ], "request_id long, doc_id long, filename string, doc_pos int, section_title string, importance_rank int, page_number int, pos_in_doc int")
    kept = R.top_sections(cand, k=5).orderBy("importance_rank").collect()
    assert [(r["section_title"], r["importance_rank"]) for r in kept] == [("A1", 1), ("B1", 2), ("A2", 3)]


def test_hook_path_and_answers(spark):
    from docstrata.plans.pipeline import Corpus
    from tests.conftest import SF_SMALL

    c = Corpus.from_fixtures(spark, SF_SMALL)

    def fake_model(prompts: pd.Series) -> pd.Series:
        out = []
        for i, p in enumerate(prompts):
            out.append('[{"section_title": "S", "importance_rank": 1, "page_number": 1}]' if i % 2 else None)
        return pd.Series(out)

    p = R.prompts(c.requests, c.request_docs, c.docs, c.headings)
    secs = R.hook_sections(p, fake_model)
    assert secs.count() == p.count()
    assert 0 < secs.filter("from_model").count() < secs.count()
    hooked = Corpus.from_fixtures(spark, SF_SMALL)
    hooked.section_model = fake_model
    titles = {s["section_title"] for r in hooked.answers().collect() for s in r["extracted_sections"]}
    assert "S" in titles and titles <= {"S", "General Information"}
    a = c.answers("2026-01-01T00:00:00")
    rows = a.collect()
    assert len(rows) == c.requests.count()
    for r in rows:
        assert len(r["extracted_sections"]) <= 5
        ranks = [s["importance_rank"] for s in r["extracted_sections"]]
        assert ranks == list(range(1, len(ranks) + 1))
        assert len(r["subsection_analysis"]) == len(ranks)
