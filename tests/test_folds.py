"""W3 / W4 folds on the edge rows of FIXTURES.md section 4, and the fold
invariants against a plain Python fold on the fixture data."""

from pyspark.sql import functions as F

from docstrata.operators import folds
from tests.conftest import block_rows


def merge(spark, rows):
    b = block_rows(spark, rows).withColumn("text_raw", F.col("text"))
    m = folds.merge_runs(b, ["text_raw"])
    return [(r["block_seq"], r["text"], r["n_merged"]) for r in m.orderBy("block_seq").collect()]


def test_font_drift_breaks_on_anchor(spark):
    rows = [(1, 1, 0, "a", 11, False, 0.1, 0), (1, 1, 1, "b", 12, False, 0.2, 0), (1, 1, 2, "c", 13, False, 0.3, 0)]
    assert merge(spark, rows) == [(0, "a b", 2), (2, "c", 1)]


def test_anchor_return(spark):
    rows = [(1, 1, 0, "a", 12, False, 0.1, 0), (1, 1, 1, "b", 13, False, 0.2, 0), (1, 1, 2, "c", 11, False, 0.3, 0)]
    assert merge(spark, rows) == [(0, "a b c", 3)]


def test_merge_breaks_on_style_page_spacing(spark):
    rows = [(1, 1, 0, "a", 12, False, 0.1, 0), (1, 1, 1, "b", 12, True, 0.2, 0),
            (1, 1, 2, "c", 12, True, 0.3, 8), (1, 2, 3, "d", 12, True, 0.1, 0)]
    assert [r[2] for r in merge(spark, rows)] == [1, 1, 1, 1]


def groups(spark, rows):
    g = folds.group_runs(block_rows(spark, rows))
    out = {}
    for r in g.collect():
        out.setdefault((r["page"], r["run_id"], r["gid"]), []).append(r["block_seq"])
    return sorted(sorted(v) for v in out.values())


def test_group_cap_four(spark):
    rows = [(1, 1, i, "Short", 12, True, 0.1 + i * 0.01, 0) for i in range(6)]
    assert groups(spark, rows) == [[0, 1, 2, 3], [4, 5]]


def test_group_length_cap(spark):
    a, b, c = "x" * 149 + "-", "y" * 150, "z"
    rows = [(1, 1, 0, a, 12, True, 0.1, 0), (1, 1, 1, b, 12, True, 0.11, 0), (1, 1, 2, c, 12, True, 0.12, 0)]
    assert groups(spark, rows) == [[0, 1], [2]]


def test_group_continuation_rules(spark):
    long1, long2 = "p" * 120, "and " + "q" * 120
    rows = [(1, 1, 0, long1, 12, False, 0.1, 0), (1, 1, 1, long2, 12, False, 0.11, 0),
            (1, 1, 2, "r" * 120, 12, False, 0.12, 0)]
    # second starts with a connective -> linked; third is long without one -> new group
    assert groups(spark, rows) == [[0, 1], [2]]


def _group_numbers(page):
    """The rule table of W3 on one page: the number of the merged block that each block is in."""
    numbers, first = [], None
    for b in page:
        rules = first is not None and (abs(b["size"] - first["size"]) < 1.5, b["bold"] == first["bold"], b["italic"] == first["italic"], b["spacing"] < 6)
        if not (rules and all(rules)):
            first = b
        numbers.append((numbers[-1] if numbers else -1) + (first is b))
    return numbers


def test_merge_equals_sequential_fold(spark):
    from docstrata.operators import blocks as B
    from docstrata.sources import fixtures
    from tests.conftest import SF_SMALL

    raw = B.raw_blocks(fixtures.fx_spans(spark, SF_SMALL))
    rows = raw.select("doc_id", "page", "y0", "block_seq", "text", F.col("avg_font_size").alias("size"),
                      F.col("is_bold").alias("bold"), F.col("is_italic").alias("italic"),
                      F.col("spacing_above").alias("spacing")).collect()
    pages = {}
    for r in sorted(rows, key=lambda r: (r["y0"], r["block_seq"])):
        pages.setdefault((r["doc_id"], r["page"]), []).append(r)
    expected = []
    for (doc, _), page in pages.items():
        members = {}
        for number, b in zip(_group_numbers(page), page):
            members.setdefault(number, []).append(b)
        expected += [(doc, m[0]["block_seq"], " ".join(b["text"] for b in m), len(m)) for m in members.values()]
    expected.sort()
    merged = folds.merge_runs(raw, ["text_raw"])
    got = sorted((r["doc_id"], r["block_seq"], r["text"], r["n_merged"]) for r in merged.collect())
    assert got == expected
