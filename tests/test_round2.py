"""Findings of the last review: rounding, long pages, request files, hot documents."""

import pytest
from pyspark.sql import functions as F

from docstrata.operators import columns, folds, topk
from docstrata.operators import structure as S
from docstrata.sources import tables
from docstrata.sources.fixtures import fx_spans
from tests.conftest import SF_SMALL, block_rows


def test_body_font_rounds_like_python(spark):
    """By the exact binary value: 10.35 is below the half, exact halves go to even."""
    sizes = [11.25, 11.75, 10.35, 11.35, 0.05, 12.0]
    sizes += [r[0] for r in fx_spans(spark, SF_SMALL).groupBy("doc_id", "page", "block_seq").agg(F.avg("size").alias("s")).select("s").distinct().collect()]
    rows = [(i, 1, 0, "text", s, False, 0.1, 5.0) for i, s in enumerate(sizes)]
    got = {r.doc_id: r.most_common_font for r in S.doc_stats(block_rows(spark, rows)).collect()}
    for i, s in enumerate(sizes):
        assert got[i] == round(s, 1), s


def test_merge_of_a_long_page(spark):
    """5,000 alternating blocks of one run equal the sequential rule."""
    n = 5000
    size = lambda i: 10.0 + (i % 2) * 1.4 + (i % 7 == 0) * 3
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("block_seq"),
        F.col("id").cast("double").alias("y0"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
        (10.0 + (F.col("id") % 2) * 1.4 + F.when(F.col("id") % 7 == 0, 3).otherwise(0)).alias("avg_font_size"),
        F.lit(False).alias("is_bold"), F.lit(False).alias("is_italic"), F.lit(1.0).alias("spacing_above"))
    got = {r.block_seq: (r.text, r.n_merged) for r in folds.merge_runs(df, []).collect()}
    starts = []
    for i in range(n):
        if not starts or abs(size(i) - size(starts[-1])) >= folds.MERGE_FONT_SIZE_THRESHOLD:
            starts.append(i)
    ends = starts[1:] + [n]
    assert got == {a: (" ".join(f"t{i}" for i in range(a, b)), b - a) for a, b in zip(starts, ends)}


# A file name and the persona of the given request.
def test_request_file_can_be_read_twice(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"documents": [{"filename": "South of France - Cities.pdf", "title": "x"}, {"filename": "b.pdf"}], '
                                     '"persona": {"role": "Travel Planner"}, "job_to_be_done": {"task": "Plan a trip"}}')
    (tmp_path / "bad.json").write_text("{no json")
    for _ in range(2):
        reqs, docs = tables.requests_from_file(tables.request_file(spark, str(tmp_path / "r.json")))
        assert [tuple(r) for r in reqs.collect()] == [(0, "Travel Planner", "Plan a trip")]
        assert [(r.filename, r.doc_pos) for r in docs.orderBy("doc_pos").collect()] == [("South of France - Cities.pdf", 1), ("b.pdf", 2)]
    bad = tables.request_file(spark, str(tmp_path / "bad.json")).collect()
    assert len(bad) == 1 and bad[0]["_corrupt_record"] and bad[0]["documents"] is None


def test_block_file_with_one_object_is_no_block_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page": 1, "text": "x"}')
    (tmp_path / "b.json").write_text(' [{"page": 1, "text": "x"}]')
    got = {r.doc_key: r.blocks for r in tables.block_files(tables.json_files(spark, str(tmp_path))).collect()}
    assert got["a"] is None and len(got["b"].toPython()) == 1


@pytest.mark.parametrize("scores", [2, 400])
def test_rank_of_a_hot_document(spark, scores):
    """One document with a third of all rows and few keys: same ranks as a sort."""
    rows = [(0 if i % 3 == 0 else i, i % 17, i, float(i * 7 % scores)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, page int, seq int, score double")
    got = topk.rank_within(df, ["doc_id"], "score", True, ["page", "seq"]).collect()
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: (-r[3], r[1], r[2]))
        assert [r.seq for r in sorted((g for g in got if g.doc_id == doc), key=lambda g: g["rank"])] == [r[2] for r in own]


def test_columns_are_cut_once_per_document(spark):
    """Two pages of one document share the cut, also far from zero."""
    far = 1e9
    rows = [(1, p, i, far + x) for p, xs in ((1, [72, 72, 300]), (2, [300, 310, 72])) for i, x in enumerate(xs)] + [(2, 1, 0, 50.0), (2, 1, 1, 50.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_seq int, bx0 double")
    got = {(r.doc_id, r.page, r.block_seq): r.column_group for r in columns.column_groups(df).collect()}
    assert got == {(d, p, s): int(d == 1 and x - far > 200) for d, p, s, x in rows}


def test_storage_must_be_shared_on_a_cluster():
    from docstrata.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session)
