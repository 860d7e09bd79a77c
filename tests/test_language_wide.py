"""a gram meets one profile row; any number of languages gives the same language."""

from docstrata.operators import language as L


def test_gram_is_joined_once_and_widths_agree(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chien et le chat"), (None, "qqq www")],
                                 "lang string, text string")
    prof = L.fit_profiles(docs).cache()
    texts = spark.createDataFrame([(1, "the dog"), (2, "der hund"), (3, "le chat"), (4, "zzz"), (5, "12"), (6, None), (7, "qqq")], "id long, text string")
    out = L.detect_language(texts, prof, ["id"])
    want = {r.id: r.language for r in out.collect()}
    assert [want[i] for i in (1, 2, 3, 5, 6)] == ["en", "de", "fr", "unknown", "unknown"] and len(want) == 7
    # one aggregation row a text: the language is no grouping key of the gram sums
    assert "_g2" in out._jdf.queryExecution().optimizedPlan().toString()
    for wide in (1, 2):
        monkeypatch.setattr(L, "WIDE", wide)
        assert {r.id: r.language for r in L.detect_language(texts, prof, ["id"]).collect()} == want
