"""op3: the counts are read off the mix, every copy at its training position."""

from pyspark.sql import functions as F

from docstrata.llm import mixing


def test_mixture_builds_the_mix_in_order(spark, monkeypatch):
    made = {}

    def written(df, name, real=mixing.written):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(mixing, "written", written)
    rows = [(i % 20 if i % 7 else None, " ".join(["w"] * (i % 9)), "abc"[i % 3] if i % 11 else None) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    out = mixing.mixture(docs).collect()
    assert len(out) == 125 and sum(r.size for r in out) == sum(len((t or "").split()) for _, t, _ in rows + rows[:5])
    copies = made["mix-copies"]
    taken = copies.where("copy IS NOT NULL")
    assert sum(r.taken for r in out) == taken.agg(F.sum("copy.words")).first()[0]
    assert taken.agg(F.max("copy.epoch")).first()[0] > 0  # later copies have positions of their own
    assert taken.where("position IS NULL OR position < 0 OR position > 1").count() == 0
    parts = [p for p in taken.select("position").rdd.glom().map(lambda p: [r.position for r in p]).collect() if p]
    ends = sorted((p[0], p[-1]) for p in parts)
    assert all(p == sorted(p) for p in parts) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert all((r.position is None) == (r.taken == 0) for r in out)
