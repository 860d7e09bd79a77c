"""J3 against brute force with the standard library; F2 sanity."""

import difflib

from pyspark.sql import functions as F

from docstrata.operators import toc as TOC
from docstrata.sources import fixtures
from tests.conftest import SF_SMALL


def test_toc_flags_equal_brute_force(spark):
    from docstrata.plans.pipeline import Corpus

    c = Corpus.from_fixtures(spark, SF_SMALL, with_toc=True, with_requests=False)
    got = {(r["doc_id"], r["page"], r["block_seq"]): r["in_TOC_flag"]
           for r in c.blocks.select("doc_id", "page", "block_seq", "in_TOC_flag").collect()}
    entries = {}
    for r in TOC.toc_entries(fixtures.fx_toc_lines(spark, SF_SMALL)).collect():
        entries.setdefault(r["doc_id"], []).append(r["entry"])
    texts = c.blocks.select("doc_id", "page", "block_seq", "text").collect()
    n_true = 0
    for r in texts:
        match = difflib.get_close_matches(r["text"].strip(), entries.get(r["doc_id"], []), n=1, cutoff=0.85)
        exp = bool(match)
        n_true += exp
        assert got[(r["doc_id"], r["page"], r["block_seq"])] == exp, r
    assert n_true > 0


def test_toc_entry_parse(spark):
    df = spark.createDataFrame([("1 Introduction ........ 1",), ("No leader 3",), ("  Scope .. 12 ",)], "line string")
    got = [r[0] for r in df.select(TOC.toc_entry(F.col("line"))).collect()]
    assert got == ["1 Introduction", None, "Scope"]


def test_language_profiles(spark):
    from docstrata.operators import language as L
    from docstrata.sources.tables import table

    docs = table(spark, SF_SMALL, "documents")
    prof = L.fit_profiles(docs).cache()
    res = L.detect_language(docs.select("doc_id", "text"), prof, ["doc_id"])
    acc = res.join(docs.select("doc_id", "lang"), "doc_id").agg(
        F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert acc > 0.9
    none = L.detect_language(spark.createDataFrame([(1, "1234 ...")], "id long, text string"), prof, ["id"])
    assert none.first()["language"] == "unknown"
