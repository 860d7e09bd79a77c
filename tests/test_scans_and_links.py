"""Rectangle-overlap join, similarity-join filter, order statistics and scans in bounded pieces, folds of long runs."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import folds, links, markup, scan, toc, topk
from docstrata.operators import requests as R
from docstrata.operators import structure as S
from docstrata.sources import fixtures
from tests.conftest import SF_SMALL

LINKS = "doc_id long, page int, link_seq int, kind int, uri string, x0 double, y0 double, x1 double, y1 double"
SPANS = "doc_id long, page int, block_seq int, line_seq int, span_seq int, text string, x0 double, y0 double, x1 double, y1 double"


# ---- links


def test_link_texts_equal_brute_force(spark):
    rng = random.Random(5)

    def box():
        x, y = rng.randrange(-30, 600), rng.randrange(-30, 800)
        return float(x), float(y), float(x + rng.randrange(-5, 300)), float(y + rng.randrange(-5, 200))

    ls = [(d, p, i, rng.choice([1, 1, 2, 4]), f"u{i}", *box()) for d in (1, 2) for p in (1, 2) for i in range(25)]
    ss = [(d, p, b, n, s, f"{b}.{n}.{s}", *box()) for d in (1, 2) for p in (1, 2) for b in range(6) for n in range(3) for s in range(4)]
    ls += [(1, 1, 99, 1, "empty", 5.0, 5.0, 5.0, 9.0), (1, 1, 98, 1, "none", None, 1.0, 2.0, 3.0), (3, 1, 0, 1, "alone", 0.0, 0.0, 9.0, 9.0),
           (1, 2, 97, 1, "nan", 0.0, 0.0, float("nan"), 10.0), (1, 2, 96, 1, None, 0.0, 0.0, 96.0, 24.0)]
    ss += [(1, 2, 50, 0, 0, "corner", 96.0, 24.0, 100.0, 30.0), (1, 2, 51, 0, 0, None, 1.0, 1.0, 2.0, 2.0)]
    want = {}
    for d, p, i, kind, uri, x0, y0, x1, y1 in ls:
        if kind == 1:
            real = None not in (x0, y0, x1, y1) and x0 < x1 and y0 < y1 and x1 == x1
            hit = sorted((s[2:5], s[5]) for s in ss if s[:2] == (d, p) and real and s[6] < s[8] and s[7] < s[9]
                         and x0 < s[8] and s[6] < x1 and y0 < s[9] and s[7] < y1)
            lines = {}
            for (b, n, _), text in hit:
                lines.setdefault((b, n), []).append(text or "")
            want[d, p, i] = (uri, "\n".join("".join(t) for t in lines.values()), len(hit))
    got = links.link_texts(spark.createDataFrame(ls, LINKS), spark.createDataFrame(ss, SPANS))
    assert {(r.doc_id, r.page, r.link_seq): (r.uri, r.link_text, r.n_spans) for r in got.collect()} == want
    assert {r.n_spans for r in got.collect()} & {0} and max(r.n_spans for r in got.collect()) > 3
    empty = spark.createDataFrame([], SPANS)
    assert links.link_texts(spark.createDataFrame(ls, LINKS), empty).where("link_text <> ''").count() == 0


def test_links_of_a_large_page(spark):
    """10^5 spans of one page: each cell has few, and pairs follow the overlaps."""
    spans = spark.range(100_000).selectExpr(
        "1L AS doc_id", "1 AS page", "cast(id div 100 as int) AS block_seq", "0 AS line_seq", "cast(id % 100 as int) AS span_seq", "'x' AS text",
        "cast(id % 100 * 60 as double) AS x0", "cast(id div 100 * 12 as double) AS y0", "cast(id % 100 * 60 + 50 as double) AS x1", "cast(id div 100 * 12 + 10 as double) AS y1")
    ls = spark.range(2000).selectExpr(
        "1L AS doc_id", "1 AS page", "cast(id as int) AS link_seq", "1 AS kind", "'u' AS uri", "cast(id % 100 * 60 + 5 as double) AS x0",
        "cast(id div 100 * 600 + 1 as double) AS y0", "cast(id % 100 * 60 + 70 as double) AS x1", "cast(id div 100 * 600 + 15 as double) AS y1")
    per_cell = links._in_cells(spans.withColumnsRenamed({c: "s" + c for c in links.BOX}), "s", links.CELL_WIDTH, links.CELL_HEIGHT)
    assert per_cell.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] <= 12
    got = links.link_texts(ls, spans)
    assert got.count() == 2000 and got.agg(F.sum("n_spans")).first()[0] == 2 * (2 * 1980 + 20)


# ---- similarity join


def test_filter_loses_no_match_and_keeps_python_idle(spark):
    rng = random.Random(9)
    words = ["one", "tower", "harbour", "Section", "of", "the", "market", "12", "island"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 45))) for _ in range(60)]
    bent = ["".join(c for c in t if rng.random() > 0.08) + rng.choice(["", " x"]) for t in texts]
    blocks = [(d, 1, i, t) for d in (1, 2) for i, t in enumerate(texts + bent + [""])]
    entries = [(d, t) for d in (1, 2) for t in texts[:40]] + [(2, "only the second")]
    b = spark.createDataFrame(blocks, "doc_id long, page int, block_seq int, text string")
    e = spark.createDataFrame(entries, "doc_id long, entry string")
    want = {}
    for d, p, i, t in blocks:
        best = max((difflib.SequenceMatcher(None, x, t).ratio() for k, x in entries if k == d), default=0)
        if best >= toc.TOC_SIMILARITY:
            want[d, p, i] = best
    got = {(r.doc_id, r.page, r.block_seq): r.best_ratio for r in toc.toc_matches(b, e).collect() if r.best_ratio >= toc.TOC_SIMILARITY}
    assert got == want and len(want) > 60
    assert toc.toc_candidates(b, e).count() < 121 * 40 * 2 / 2  # of all pairs of a document


def test_blocks_beyond_one_salt_meet_the_entries(spark, monkeypatch):
    monkeypatch.setattr(toc, "SALT_BLOCKS", 16)
    b = spark.createDataFrame([(1, 1 + i // 10, i, f"Chapter number {i}") for i in range(100)], "doc_id long, page int, block_seq int, text string")
    e = spark.createDataFrame([(1, f"Chapter number {i}") for i in (3, 55, 99)], "doc_id long, entry string")
    assert {r.block_seq for r in toc.toc_matches(b, e).collect() if r.best_ratio == 1.0} == {3, 55, 99}


def test_pairs_that_reach_python_on_the_tables(spark):
    lines = fixtures.fx_toc_lines(spark, SF_SMALL)
    blocks = fixtures.fx_lines(spark, SF_SMALL).select("doc_id", "page", "block_seq", F.col("line").alias("text"))
    entries = toc.toc_entries(lines)
    flags = toc.toc_matches(blocks, entries).filter(F.col("best_ratio") >= toc.TOC_SIMILARITY).count()
    pairs = toc.toc_candidates(blocks, entries).count()
    every = blocks.join(entries, "doc_id").count()
    assert flags > 100 and pairs < every / 5


# ---- order statistics


@pytest.mark.parametrize("small", [4096, 3])
def test_percentiles_equal_numpy(spark, small):
    """Selected by ranges or in one buffer, the doubles are the same."""
    rng = random.Random(4)
    rows = [(d, rng.choice([9.0, 11.5, rng.random() * 30, float(rng.randrange(40))])) for d in range(6) for _ in range(1 + d * 70)]
    rows += [(7, None), (8, 3.25), (8, None), (9, 1.0), (9, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, v double")
    ps = [0.0, 0.25, 0.5, 0.85, 0.95, 1.0]
    got = {r.doc_id: r.pct for r in scan.percentiles(df, ["doc_id"], "v", ps, small=small, ranges=8).collect()}
    for d in {r[0] for r in rows if r[1] is not None}:
        values = [v for k, v in rows if k == d and v is not None]
        assert np.allclose(got[d], np.percentile(values, [100 * p for p in ps]), rtol=1e-12)
    assert 7 not in got
    one = {r.doc_id: r.pct for r in scan.percentiles(df, ["doc_id"], "v", ps).collect()}
    assert got == one


def test_selection_sorts_parts_of_a_document(spark):
    """A document of 10^6 distinct sizes: no range holds an eighth of them."""
    df = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), (8 + 20 * F.rand(3)).alias("v"))
    dist = scan.counted(df, ["doc_id"], "v")
    ranged = scan._ranged(dist, scan._sizes(dist, ["doc_id"], scan.RANGES), ["doc_id"])
    assert ranged.groupBy("r").count().agg(F.max("count")).first()[0] < 1_000_000 / 8
    got = scan.percentiles(df, ["doc_id"], "v", [0.5, 0.95]).first().pct
    assert got == list(df.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))).first()[0])


@pytest.mark.parametrize("small", [4096, 3])
def test_cumulative_equals_a_window(spark, small):
    rng = random.Random(2)
    rows = [(d, rng.randrange(200) / 4) for d in range(4) for _ in range(300)]
    dist = scan.counted(spark.createDataFrame(rows, "doc_id long, v double"), ["doc_id"], "v")
    got = {(r.doc_id, r.v): (r.le, r.n) for r in scan.cumulative(dist, ["doc_id"], small=small, ranges=5).collect()}
    assert got == {(d, v): (sum(x <= v for k, x in rows if k == d), 300) for d, v in set(rows)}


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_running_equals_a_plain_scan(spark, chunk):
    rng = random.Random(chunk)
    rows = [(d, o, rng.randrange(100)) for d in range(3) for o in rng.sample(range(90), 60)]
    df = spark.createDataFrame(rows, "doc_id long, page int, v long")
    got = {(r.doc_id, r.page): r.before for r in scan.running(df, ["doc_id"], "page", "v", "before", chunk=chunk).collect()}
    assert got == {(d, o): sum(v for k, q, v in rows if k == d and q < o) for d, o, _ in rows}
    got = {(r.doc_id, r.page): r.top for r in scan.running(df, ["doc_id"], "page", "v", "top", how="max", chunk=chunk).collect()}
    assert got == {(d, o): max((v for k, q, v in rows if k == d and q < o), default=None) for d, o, _ in rows}


def test_a_document_of_a_million_pages(spark):
    pages = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page"), (F.col("id") % 5).alias("v"))
    got = scan.running(pages, ["doc_id"], "page", "v", "before")
    last = got.orderBy(F.desc("page")).first()
    assert last.before == sum(i % 5 for i in range(999_999)) and got.count() == 1_000_000


def test_rank_within_equals_a_window(spark):
    rng = random.Random(7)
    rows = [(d, rng.randrange(1, 30), float(i), i, rng.choice([1.0, 2.5, 2.5, 7.0])) for d in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, page int, first_y0 double, first_seq int, score double")
    got = {(r.doc_id, r.first_seq): r.rank for r in topk.rank_within(df, ["doc_id"], "score", True, ["page", "first_y0", "first_seq"]).collect()}
    for d in range(3):
        order = sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], r[1], r[2], r[3]))
        assert all(got[d, r[3]] == k + 1 for k, r in enumerate(order))


def test_sections_carried_over_pages(spark):
    rng = random.Random(3)
    rows = [(1, p, float(s), s, rng.random() < 0.02) for p in rng.sample(range(1, 5000), 800) for s in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page int, first_y0 double, first_seq int, is_heading boolean")
    got = {(r.page, r.first_seq): tuple(r.section) if r.section else None for r in R.assign_sections(df).collect()}
    last = None
    for _, p, y, s, h in sorted(rows):
        last = (p, y, s) if h else last
        assert got[p, s] == last


# ---- rounding


def test_tenths_round_like_python(spark):
    rng = random.Random(6)
    values = [k / 20 for k in range(2000)] + [rng.random() * 40 for _ in range(2000)]
    values += [float(np.nextafter(k / 20, d)) for k in range(1, 800) for d in (0, 100)] + [10.35, 11.35, 0.05, 0.25, 2.675]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.round_tenth(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 1) for r in got)


# ---- folds


def _steps(sizes, threshold):
    """Group starts by the rule: a row begins a group if it differs from the group's first by the threshold."""
    starts = [0]
    for i, x in enumerate(sizes):
        if i and not abs(x - sizes[starts[-1]]) < threshold:
            starts.append(i)
    return starts


def _page(spark, rows):
    return spark.createDataFrame(
        [(1, 1, i, float(i), t, s) for i, (t, s) in enumerate(rows)],
        "doc_id long, page int, block_seq int, y0 double, text string, avg_font_size double").selectExpr(
        "*", "false AS is_bold", "false AS is_italic", "1.0D AS spacing_above", "'F' AS font_name", "0.1D AS y_position_relative")


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 257, 1000])
def test_long_runs_fold_like_short_ones(spark, n):
    rng = random.Random(n)
    rows = [("t" * rng.choice([1, 20, 99, 100]), rng.choice([10.0, 10.75, 11.25, 11.5, 12.75, 14.0])) for _ in range(n)]
    got = folds.merge_runs(_page(spark, rows), []).orderBy("block_seq").collect()
    starts = _steps([s for _, s in rows], folds.MERGE_FONT_SIZE_THRESHOLD)
    assert [r.block_seq for r in got] == starts
    assert [r.n_merged for r in got] == [b - a for a, b in zip(starts, starts[1:] + [n])]
    same = [(t, 12.0) for t, _ in rows]
    groups = {}
    for r in folds.group_runs(_page(spark, same)).collect():
        groups.setdefault(r.gid, []).append(r.block_seq)
    want, at = [], 0
    while at < n:
        size, total = 1, len(same[at][0])
        while size < folds.GROUP_MAX_ITEMS and at + size < n and total + len(same[at + size][0]) <= folds.GROUP_MAX_CHARS:
            total += len(same[at + size][0])
            size += 1
        want.append(list(range(at, at + size)))
        at += size
    assert sorted(sorted(g) for g in groups.values()) == want


def test_a_page_of_200_000_blocks(spark):
    n = 200_000
    df = spark.range(n).selectExpr(
        "1L AS doc_id", "1 AS page", "cast(id as int) AS block_seq", "cast(id as double) AS y0", "'ab' AS text", "10 + (id % 7) * 0.5D AS avg_font_size",
        "false AS is_bold", "false AS is_italic", "1.0D AS spacing_above", "'F' AS font_name", "0.1D AS y_position_relative")
    starts = _steps([10 + (i % 7) * 0.5 for i in range(n)], folds.MERGE_FONT_SIZE_THRESHOLD)
    merged = folds.merge_runs(df, [])
    assert merged.agg(F.count(F.lit(1)), F.sum("block_seq"), F.sum("n_merged")).first() == (len(starts), sum(starts), n)
    even = folds.group_runs(df.withColumn("avg_font_size", F.lit(12.0)))
    assert even.agg(F.max("gid"), F.count(F.lit(1))).first() == (n // 4 - 1, n)


def test_rows_without_a_size(spark):
    rows = [("a", 12.0)] * 40 + [("b", None)] + [("c", 12.0)] * 3
    got = folds.merge_runs(_page(spark, rows), []).orderBy("block_seq").collect()
    assert [r.block_seq for r in got] == [0]  # an unknown size differs from none


def test_sizes_at_the_threshold(spark):
    """abs(x - anchor) decides at the last bit, in long runs as in short ones."""
    rows = [("a", 0.1 + 0.1 * (i % 40)) for i in range(400)]
    got = [r.block_seq for r in folds.merge_runs(_page(spark, rows), []).orderBy("block_seq").collect()]
    assert got == _steps([s for _, s in rows], folds.MERGE_FONT_SIZE_THRESHOLD)


# ---- markup


def _spans(spark, pages, **options):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in markup.markup_spans(df, **options).orderBy("doc_id", "span_seq").collect():
        got.setdefault(r.doc_id, []).append((r.block_seq, r.line_seq, r.text, r.size, bool(r.flags & 16), bool(r.flags & 2)))
    return got


def test_nested_tags(spark):
    got = _spans(spark, [
        "<div>a<p>b <b>c <i>d</i> e</b> f</p>g</div>",
        "<ul><li>one<li>two<ul><li>in</ul>three</ul>after",
        "<p><b>open<br>line two<p>next</i> stays<img src=x>image",
        "text <!-- <p>no</p> --><script>var x = '<p>'</script><STYLE>p{}</STYLE><H1>Big</H1></nothing> end",
        "", None, "   \n ", "<p></p>", "a < b <"])
    assert got[0] == [(1, 0, "a", 10.0, False, False), (2, 0, "b ", 11.0, False, False), (2, 0, "c ", 14.0, True, False), (2, 0, "d", 14.0, True, True),
                      (2, 0, " e", 14.0, True, False), (2, 0, " f", 11.0, False, False), (3, 0, "g", 10.0, False, False)]
    assert [(x[2], x[3]) for x in got[1]] == [("one", 10.0), ("two", 10.0), ("in", 10.0), ("three", 10.0), ("after", 11.0)]
    assert len({x[0] for x in got[1]}) == 5
    # the second p ends the first and the b inside it; a closing tag that is not open does nothing
    assert got[2] == [(1, 0, "open", 14.0, True, False), (1, 1, "line two", 14.0, True, False), (2, 0, "next", 11.0, False, False),
                      (2, 0, " stays", 11.0, False, False), (2, 0, "image", 11.0, False, False)]
    assert [(x[2], x[3], x[4]) for x in got[3]] == [("text ", 11.0, False), ("Big", 20.0, True), (" end", 11.0, False)]
    assert set(got) == {0, 1, 2, 3, 8} and [x[2] for x in got[8]] == ["a ", " b "]


def test_chunks_do_not_show(spark):
    rng = random.Random(8)
    pages = ["".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "x", "y z", "<br>", "<i>", "</i>", "<div>", "</div>"]) for _ in range(200))
             for _ in range(12)]
    assert _spans(spark, pages, chunk=3) == _spans(spark, pages)


def test_a_page_of_many_events(spark):
    n = 60_000
    df = spark.range(1).selectExpr("id AS page_id", f"repeat(concat('<p>a<b>b</b></p>', substring(cast(id AS string), 1, 0)), {n}) AS html")  # no constant
    assert markup.markup_spans(df).agg(F.count(F.lit(1)), F.max("block_seq"), F.sum("size")).first() == (2 * n, 2 * n - 1, 25.0 * n)
