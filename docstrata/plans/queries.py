"""
each a Spark job over the driver's tables at ``sf_dir`` plus, where the
result is SQL-expressible, the independent DuckDB statement that must
give the same rows. Derived doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fonts
from ..functions.text import collapse_ws, count_char, strip, word_count
from ..operators import blocks as B
from ..operators import folds
from ..operators import requests as R
from ..operators import structure as S
from ..operators import toc as TOC
from ..operators.features import feature_columns
from ..operators.topk import rank_within
from ..sources import fixtures, tables
from . import oracle_sql as O
from .pipeline import Corpus

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def sr6(x: str) -> str:
    return f"round({x}, 6)"


def _corpus(spark: SparkSession, sf: str, **kw) -> Corpus:
    return Corpus.from_fixtures(spark, sf, **kw)


S1 = O.chain(*O.STAGE1)
S2 = O.chain(*O.STAGE2)
STYLE_COLS = O.STYLES

# ---------------------------------------------------------------- sources

@register("src1_span_scan", O.chain(O.FX_LINES, O.FX_SPANS) + """
SELECT doc_id, count(*) AS n_spans, count(DISTINCT page * 1000000 + block_seq) AS n_blocks,
  count(DISTINCT page) AS n_pages FROM fx_spans GROUP BY doc_id""")
def q_src1(spark, sf):
    s = fixtures.fx_spans(spark, sf)
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.countDistinct("page", "block_seq").alias("n_blocks"),
        F.countDistinct("page").alias("n_pages"))


_TAG_SIZE = "CASE tag " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in fixtures.HTML_TAG_SIZES.items()) + " END"


@register("src2_html_spans", O.chain(O.FX_HTML_SPANS) + f"""
SELECT page_id, span_seq, tag, text, {_TAG_SIZE} AS size, tag IN ('title', 'h1', 'b') AS is_bold FROM fx_html_spans""")
def q_src2(spark, sf):
    h = fixtures.fx_html_spans(spark, sf)
    return h.select("page_id", "span_seq", "tag", "text", fixtures.html_tag_size(F.col("tag")).alias("size"),
                    F.col("tag").isin(*fixtures.HTML_BOLD_TAGS).alias("is_bold"))


@register("src2_blocks", O.chain(O.MARKUP) + f"""
SELECT page_id AS doc_id, block AS block_seq, {O.strip("string_agg(text, ' ' ORDER BY line, n)")} AS text, {sr6('avg(size)')} AS avg_font_size,
  bool_or(bold) AS is_bold, bool_or(italic) AS is_italic, CAST(max(line) AS INT) AS last_line, count(*) AS n_spans
FROM msp GROUP BY page_id, block HAVING {O.strip("string_agg(text, ' ' ORDER BY line, n)")} <> ''""")
def q_src2_blocks(spark, sf):
    """Markup through the stack fold and the block assembly (A1)."""
    from ..operators.markup import markup_spans

    spans = markup_spans(tables.spread(tables.table(spark, sf, "pages").select("page_id", "html"), "page_id"))
    size = spans.groupBy("doc_id", "block_seq").agg(F.max("line_seq").alias("last_line"), F.count(F.lit(1)).alias("n_spans"))
    return B.assemble_blocks(spans).join(size, ["doc_id", "block_seq"]).select(
        "doc_id", "block_seq", "text", r6("avg_font_size").alias("avg_font_size"), "is_bold", "is_italic", "last_line", "n_spans")


@register("src3_toc_lines", O.chain(O.FX_LINES, O.FX_TOC_LINES) + """
SELECT doc_id, page, line_no, line FROM fx_toc_lines WHERE page <= 3""")
def q_src3(spark, sf):
    return fixtures.fx_toc_lines(spark, sf).filter(F.col("page") <= TOC.TOC_MAX_PAGES)


_TOC_PAT = r"^(.+?)[\s\p{Z}]+\.{2,}[\s\p{Z}]+(\p{Nd}+)$"


@register("f3_toc_entries", O.chain(O.FX_LINES, O.FX_TOC_LINES) + f"""
SELECT doc_id, line_no, {O.strip("regexp_extract(" + O.strip("line") + f", '{_TOC_PAT}', 1)")} AS entry
FROM fx_toc_lines WHERE page <= 3 AND regexp_matches({O.strip("line")}, '{_TOC_PAT}')""")
def q_f3(spark, sf):
    return TOC.toc_entries(fixtures.fx_toc_lines(spark, sf)).select("doc_id", "line_no", "entry")


@register("src4_links", O.chain(O.FX_LINKS) + """
SELECT doc_id, page, link_seq, uri, link_text FROM fx_links""")
def q_src4(spark, sf):
    return fixtures.fx_links(spark, sf)


@register("src4_link_texts", O.chain(O.FX_LINES, O.FX_SPANS, O.FX_BOXES, O.FX_PAGE_LINKS) + """,
under AS (
SELECT l.doc_id, l.page, l.link_seq, s.block_seq, s.line_seq, string_agg(s.text, '' ORDER BY s.span_seq) AS line, count(*) AS n
FROM fx_page_links l JOIN fx_boxes s ON l.doc_id = s.doc_id AND l.page = s.page AND l.x0 < s.x1 AND s.x0 < l.x1 AND l.y0 < s.y1 AND s.y0 < l.y1
WHERE l.kind = 1 GROUP BY ALL),
texts AS (SELECT doc_id, page, link_seq, string_agg(line, chr(10) ORDER BY block_seq, line_seq) AS link_text, sum(n) AS n FROM under GROUP BY ALL)
SELECT l.doc_id, l.page, l.link_seq, l.uri, l.x0, l.y0, l.x1, l.y1, coalesce(t.link_text, '') AS link_text, CAST(coalesce(t.n, 0) AS BIGINT) AS n_spans
FROM fx_page_links l LEFT JOIN texts t USING (doc_id, page, link_seq) WHERE l.kind = 1""")
def q_src4_texts(spark, sf):
    from ..operators.links import link_texts

    out = link_texts(fixtures.fx_page_links(spark, sf), fixtures.fx_span_boxes(spark, sf))
    return out.select("doc_id", "page", "link_seq", "uri", "rect.*", "link_text", "n_spans")


@register("src5_block_files", O.chain(O.FX_LINES, O.FX_FILE_ELEMENTS) + """
SELECT doc_key, block_seq, CASE WHEN n % 3 <> 0 AND n % 8 = 0 THEN NULL ELSE page END AS page,
  CASE WHEN n % 4 = 0 THEN NULL ELSE line END AS text, CASE WHEN n % 9 = 0 OR n % 10 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS avg_font_size
FROM fx_elements WHERE n % 13 <> 0""")
def q_src5(spark, sf):
    rows = tables.explode_block_files(tables.block_files(fixtures.fx_block_files(spark, sf)))
    return rows.select("doc_key", "block_seq", "page", "text", "avg_font_size")


@register("snk5_bad_records", O.chain(O.FX_LINES, O.FX_FILE_ELEMENTS) + """
SELECT doc_key, CAST(NULL AS INT) AS block_seq, CAST(NULL AS VARCHAR) AS field, error FROM (
  SELECT DISTINCT 'file ' || CAST(doc_id AS VARCHAR) AS doc_key, doc_id % 11 AS d,
    CASE doc_id % 11 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'no array but OBJECT' ELSE 'empty file' END AS error FROM fx_lines WHERE doc_id % 11 IN (0, 1, 3))
UNION ALL SELECT doc_key, block_seq, NULL, 'element is no object' FROM fx_elements WHERE n % 13 = 0
UNION ALL SELECT doc_key, block_seq, 'page', 'ARRAY is no int' FROM fx_elements WHERE n % 13 <> 0 AND n % 3 <> 0 AND n % 8 = 0
UNION ALL SELECT doc_key, block_seq, 'avg_font_size', 'STRING is no double' FROM fx_elements WHERE n % 13 <> 0 AND n % 9 = 0""")
def q_snk5(spark, sf):
    from ..sources import sinks

    bad = sinks.bad_records(tables.block_files(fixtures.fx_block_files(spark, sf)), "structure")
    return bad.select("doc_key", "block_seq", "field", F.regexp_replace("error", "(?s)^(malformed JSON): .*", "$1").alias("error"))


@register("src8_request_docs", O.chain(O.FX_REQUESTS) + """
SELECT d.request_id, CAST(d.doc_pos AS BIGINT) AS doc_pos, d.filename, r.persona, r.task
FROM fx_request_docs d JOIN fx_requests r USING (request_id)""")
def q_src8(spark, sf):
    d = fixtures.fx_request_docs(spark, sf)
    r = fixtures.fx_requests(spark, sf)
    return d.join(r, "request_id").select("request_id", F.col("doc_pos").cast("long").alias("doc_pos"),
                                          "filename", "persona", "task")


_NAMED = "CASE doc_id % 5 WHEN 0 THEN source || '.PDF' WHEN 1 THEN source || '.pdf.pdf' WHEN 2 THEN source || '.json' WHEN 3 THEN source ELSE source || '.pdf' END"


@register("p22_doc_keys", f"""SELECT DISTINCT filename,
  CASE WHEN ends_with(j, '.json') THEN left(j, length(j) - 5) END AS doc_key
FROM (SELECT filename, replace(filename, '.pdf', '.json') AS j FROM (SELECT {_NAMED} AS filename FROM documents))""")
def q_p22(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.expr(_NAMED).alias("filename")).distinct()
    return d.select("filename", R.doc_key(F.col("filename")).alias("doc_key"))


# ---------------------------------------------------------------- stage 1

@register("a1_blocks", S1 + f"""
SELECT doc_id, page, block_seq, text, {sr6('avg_font_size')} AS avg_font_size, font_name, last_color, last_flags,
  is_strikethrough, {", ".join(STYLE_COLS)} FROM rb""")
def q_a1(spark, sf):
    b = B.assemble_blocks(fixtures.fx_spans(spark, sf))
    return b.select("doc_id", "page", "block_seq", "text", r6("avg_font_size").alias("avg_font_size"), "font_name",
                    "last_color", "last_flags", "is_strikethrough", *STYLE_COLS)


@register("p1_blank_filter", O.chain(O.FX_LINES, O.FX_SPANS, O.FX_BLANKS) + """,
rawb AS (SELECT doc_id, page, block_seq, string_agg(text, ' ' ORDER BY line_seq, span_seq) AS t FROM fx_blank_spans GROUP BY ALL)
SELECT doc_id, count(*) AS n_raw, count(*) FILTER (WHERE """ + O.strip("t") + """ <> '') AS n_kept FROM rawb GROUP BY doc_id""")
def q_p1(spark, sf):
    s = fixtures.fx_spans_with_blanks(spark, sf)
    raw = s.groupBy("doc_id").agg(F.count_distinct("page", "block_seq").alias("n_raw"))
    kept = B.assemble_blocks(s).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return raw.join(kept, "doc_id", "left").select("doc_id", "n_raw", F.coalesce("n", F.lit(0)).alias("n_kept"))


@register("a2_median_size", S1 + f"SELECT doc_id, {sr6('median_font_size')} AS median_font_size FROM sstats")
def q_a2(spark, sf):
    st = B.span_doc_stats(fixtures.fx_spans(spark, sf))
    return st.select("doc_id", r6("median_font_size").alias("median_font_size"))


@register("a3_dominant_font", S1 + "SELECT doc_id, dominant_font FROM dom")
def q_a3(spark, sf):
    return B.span_doc_stats(fixtures.fx_spans(spark, sf)).select("doc_id", "dominant_font")


@register("p8_font_styles", O.chain(O.FX_LINES, O.FX_SPANS) + "SELECT DISTINCT font, flags, "
          + ", ".join(f"{e} AS {k}" for k, e in O.SPAN_STYLES.items())
          + f", {O.SPAN_REGULAR} AS is_regular, {O.SPAN_OBLIQUE} AS is_oblique FROM fx_spans")
def q_p8(spark, sf):
    s = fixtures.fx_spans(spark, sf).select("font", "flags").distinct()
    st = fonts.font_styles(F.col("font"), F.col("flags"))
    return s.select("font", "flags", *[v.alias(k) for k, v in st.items()])


@register("w1_spacing", S1 + f"SELECT doc_id, page, block_seq, {sr6('spacing_above')} AS spacing_above FROM rbs")
def q_w1(spark, sf):
    b = B.raw_blocks(fixtures.fx_spans(spark, sf))
    return b.select("doc_id", "page", "block_seq", r6("spacing_above").alias("spacing_above"))


@register("o1_page_order", S1 + "SELECT doc_id, page, block_seq, CAST(rn AS INT) AS pos_in_page FROM rbs")
def q_o1(spark, sf):
    b = B.raw_blocks(fixtures.fx_spans(spark, sf))
    w = folds.page_window(["y0", "block_seq"])
    return b.select("doc_id", "page", "block_seq", F.row_number().over(w).cast("int").alias("pos_in_page"))


@register("w3_merge", S1 + f"""
SELECT doc_id, page, block_seq, text, {sr6('spacing_above')} AS spacing_above, CAST(n_merged AS BIGINT) AS n_merged FROM mg""")
def q_w3(spark, sf):
    raw = B.raw_blocks(fixtures.fx_spans(spark, sf))
    m = folds.merge_runs(raw, B.RAW_PAYLOAD)
    return m.select("doc_id", "page", "block_seq", "text", r6("spacing_above").alias("spacing_above"),
                    F.col("n_merged").cast("long").alias("n_merged"))


@register("w2_block_numbering", S1 + """
SELECT doc_id, block_seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, block_seq) - 1 AS INT) AS block_no FROM mg""")
def q_w2(spark, sf):
    blk = _corpus(spark, sf, with_requests=False).blocks
    return B.number_blocks(blk).select("doc_id", "block_seq", "block_no")


_D2_DOUBLES = ["avg_font_size", "font_size_diff", "indentation_ratio", "caps_ratio", "y_position_relative",
               "spacing_above", "flesch_reading_ease", "smog_index", "coleman_liau"]
_D2_OTHER = ["page", "text", "font_diff_from_body", "font_name", *STYLE_COLS, "text_color_r", "text_color_g",
             "text_color_b", "is_black_text", "is_underlined", "is_strikethrough", "is_header", "is_footer",
             "is_title_case", "is_short", "starts_with_numbering", "is_center_aligned", "is_bullet_point"]


def _blk_sql(cols_other: list[str], cols_double: list[str]) -> str:
    sel = ["doc_id", "block_seq", *cols_other, *[f"{sr6(c)} AS {c}" for c in cols_double]]
    return S1 + "SELECT " + ", ".join(sel) + " FROM blk"


def _blk_spark(spark, sf, cols_other, cols_double):
    blk = _corpus(spark, sf, with_requests=False).blocks
    return blk.select("doc_id", "block_seq", *cols_other, *[r6(c).alias(c) for c in cols_double])


@register("c1_blocks", _blk_sql(_D2_OTHER + ["column_group"], _D2_DOUBLES).replace(
    "column_group FROM blk", "CAST(0 AS INT) AS column_group FROM blk").replace(
    ", column_group, ", ", CAST(0 AS INT) AS column_group, "))
def q_c1(spark, sf):
    return _blk_spark(spark, sf, _D2_OTHER + ["column_group"], _D2_DOUBLES)


for _key, _other, _dbl in [
    ("p2_p3_colors", ["text_color_r", "text_color_g", "text_color_b", "is_black_text"], []),
    ("p4_p7_positions", ["is_header", "is_footer", "is_center_aligned"], ["indentation_ratio", "y_position_relative"]),
    ("p9_p10_font_diffs", ["font_diff_from_body"], ["font_size_diff"]),
    ("p11_underline_strike", ["is_underlined", "is_strikethrough"], []),
    ("p12_p16_text_flags", ["is_short", "starts_with_numbering", "is_bullet_point", "is_title_case"], ["caps_ratio"]),
    ("f1_readability", [], ["flesch_reading_ease", "smog_index", "coleman_liau"]),
]:
    register(_key, _blk_sql(_other, _dbl))(
        (lambda o, d: (lambda spark, sf: _blk_spark(spark, sf, o, d)))(_other, _dbl))


_F15 = S1.rstrip("\n") + """,
hx AS (SELECT doc_id, bx0 AS x, bx0 - min(bx0) OVER (PARTITION BY doc_id) AS d FROM rbs),
cx AS (
SELECT a.doc_id, a.x, round(
    sum(b.d * b.d) FILTER (WHERE b.x <= a.x) - sum(b.d) FILTER (WHERE b.x <= a.x) * sum(b.d) FILTER (WHERE b.x <= a.x) / count(*) FILTER (WHERE b.x <= a.x)
    + sum(b.d * b.d) FILTER (WHERE b.x > a.x) - sum(b.d) FILTER (WHERE b.x > a.x) * sum(b.d) FILTER (WHERE b.x > a.x) / count(*) FILTER (WHERE b.x > a.x), 6) AS e
FROM (SELECT DISTINCT doc_id, x FROM hx) a JOIN hx b USING (doc_id) GROUP BY a.doc_id, a.x HAVING count(*) FILTER (WHERE b.x > a.x) > 0),
cut AS (SELECT doc_id, arg_min(x, {'e': e, 'x': x}) AS cut_x FROM cx GROUP BY doc_id)
SELECT b.doc_id, b.block_seq, CASE WHEN b.bx0 > c.cut_x THEN 1 ELSE 0 END AS column_group
FROM mg b LEFT JOIN cut c USING (doc_id)"""


@register("f15_column_groups", _F15)
def q_f15(spark, sf):
    c = Corpus.from_fixtures(spark, sf, with_requests=False)
    c.cluster_columns = True
    return c.blocks.select("doc_id", "block_seq", F.col("column_group").cast("int").alias("column_group"))


@register("j3_toc_flags")
def q_j3(spark, sf):
    blk = _corpus(spark, sf, with_toc=True, with_requests=False).blocks
    return blk.select("doc_id", "page", "block_seq", "in_TOC_flag")


def _gram_rows_sql(key: str, text: str, src: str) -> str:
    """All 3-grams of ' ' + w1 + ' ' + ... + wk + ' ' (w = letter runs,
    lower-case) as rows, in linear time: grams inside each padded word,
    plus one gram across each pair of neighbouring words."""
    ws = rf"list_filter(string_split(regexp_replace(lower({text}), '[^\p{{L}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""SELECT {key}, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram
  FROM (SELECT {key}, unnest(ws) AS w FROM (SELECT {key}, {ws} AS ws FROM {src}))
  UNION ALL
  SELECT {key}, unnest(list_transform(range(1, len(ws)), lambda i: substr(ws[i], length(ws[i]), 1) || ' ' || substr(ws[i + 1], 1, 1))) AS gram
  FROM (SELECT {key}, {ws} AS ws FROM {src})"""


_F2 = S1.rstrip("\n") + f""",
dg AS ({_gram_rows_sql('lang', 'text', 'documents')}),
pc AS (SELECT lang, gram, count(*) AS cnt FROM dg WHERE gram <> '   ' GROUP BY lang, gram),
pden AS (SELECT lang, CAST(sum(cnt) + count(*) AS DOUBLE) AS den FROM pc GROUP BY lang),
prof AS (SELECT p.lang, p.gram, ln(CAST(p.cnt + 1 AS DOUBLE) / d.den) AS logp, ln(1.0 / d.den) AS dflt FROM pc p JOIN pden d USING (lang)),
dfl AS (SELECT DISTINCT lang, dflt FROM prof),
fbl AS (SELECT lang, dflt FROM dfl ORDER BY dflt DESC, lang LIMIT 1),
bg AS ({_gram_rows_sql('doc_id, page, block_seq', 'anchor_text', 'blk')}),
bc AS (SELECT doc_id, page, block_seq, gram, count(*) AS cnt FROM bg WHERE gram <> '   ' GROUP BY ALL),
bn AS (SELECT doc_id, page, block_seq, sum(cnt) AS n FROM bc GROUP BY ALL),
gain AS (SELECT b.doc_id, b.page, b.block_seq, p.lang, sum(b.cnt * (p.logp - p.dflt)) AS g
         FROM bc b JOIN prof p USING (gram) GROUP BY ALL),
sc2 AS (
  SELECT g.doc_id, g.page, g.block_seq, g.lang, n.n * d.dflt + g.g AS score
  FROM gain g JOIN dfl d USING (lang) JOIN bn n USING (doc_id, page, block_seq)
  UNION ALL
  SELECT n.doc_id, n.page, n.block_seq, f.lang, n.n * f.dflt FROM bn n, fbl f),
bestl AS (SELECT doc_id, page, block_seq, arg_max(lang, {{'s': score, 'l': lang}}) AS language FROM sc2 GROUP BY ALL)
SELECT k.doc_id, k.page, k.block_seq,
  CASE WHEN regexp_matches(k.anchor_text, '\\p{{L}}') THEN coalesce(b.language, 'unknown') ELSE 'unknown' END AS language
FROM blk k LEFT JOIN bestl b USING (doc_id, page, block_seq)"""


@register("f2_language", _F2)
def q_f2(spark, sf):
    from ..operators import language as L
    from ..sources.tables import table

    from .pipeline import write_stage

    prof = write_stage(L.fit_profiles(table(spark, sf, "documents")))  # fitted model table
    c = Corpus(fixtures.fx_spans(spark, sf), language_profiles=prof, derived=True)
    return c.blocks.select("doc_id", "page", "block_seq", "language")


# ---------------------------------------------------------------- stage 2

_GKEY = ["doc_id", "page", "first_seq"]


@register("w4_groups", S2 + "SELECT doc_id, page, first_seq, CAST(group_size AS BIGINT) AS group_size, text FROM grp")
def q_w4(spark, sf):
    g = _corpus(spark, sf, with_requests=False).groups
    return g.select(*_GKEY, F.col("group_size").cast("long").alias("group_size"), "text")


@register("a4_doc_stats", S2 + f"""SELECT doc_id, CAST(total_items AS BIGINT) AS total_items, {sr6('doc_bold_ratio')} AS bold_ratio,
  {sr6('doc_center_ratio')} AS center_ratio, {sr6('doc_avg_spacing')} AS avg_spacing FROM dstats""")
def q_a4(spark, sf):
    st = _corpus(spark, sf, with_requests=False).stats
    return st.select("doc_id", F.col("total_items").cast("long").alias("total_items"), r6("bold_ratio").alias("bold_ratio"),
                     r6("center_ratio").alias("center_ratio"), r6("avg_spacing").alias("avg_spacing"))


@register("a5_body_font", S2 + f"SELECT doc_id, {sr6('most_common_font')} AS most_common_font FROM body")
def q_a5(spark, sf):
    st = _corpus(spark, sf, with_requests=False).stats
    return st.select("doc_id", r6("most_common_font").alias("most_common_font"))


_PCT = ["font_p50", "font_p75", "font_p85", "font_p95"]


@register("a6_font_percentiles", S2 + "SELECT doc_id, " + ", ".join(f"{sr6(c)} AS {c}" for c in _PCT) + " FROM dstats")
def q_a6(spark, sf):
    st = _corpus(spark, sf, with_requests=False).stats
    return st.select("doc_id", *[r6(c).alias(c) for c in _PCT])


_A7_D = ["avg_font_size", "max_font_size", "font_std", "min_y_position", "avg_y_position", "bold_ratio",
         "italic_ratio", "center_ratio", "avg_spacing", "max_spacing", "avg_caps_ratio", "avg_indentation"]
_A7_O = ["any_bold", "any_center", "has_hyphen_split", "has_colon_split"]


@register("a7_group_aggregates", S2 + "SELECT doc_id, page, first_seq, CAST(group_size AS BIGINT) AS group_size, "
          + ", ".join(_A7_O) + ", " + ", ".join(f"{sr6(c)} AS {c}" for c in _A7_D) + " FROM grp")
def q_a7(spark, sf):
    g = _corpus(spark, sf, with_requests=False).groups
    return g.select(*_GKEY, F.col("group_size").cast("long").alias("group_size"), *_A7_O,
                    *[r6(c).alias(c) for c in _A7_D])


@register("j4_group_doc_stats", S2 + f"""SELECT doc_id, page, first_seq, {sr6('font_p95')} AS font_p95,
  {sr6('most_common_font')} AS most_common_font, {sr6('doc_avg_spacing')} AS doc_avg_spacing FROM gs""")
def q_j4(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, r6("font_p95").alias("font_p95"), r6("most_common_font").alias("most_common_font"),
                    r6("doc_avg_spacing").alias("doc_avg_spacing"))


@register("j5_font_percentile", S2 + f"SELECT doc_id, page, first_seq, {sr6('font_percentile')} AS font_percentile FROM gs")
def q_j5(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, r6("font_percentile").alias("font_percentile"))


_WC = O.word_count("text")
_F12_SQL = {
    "text_length": "CAST(length(text) AS BIGINT)", "word_count": f"CAST({_WC} AS BIGINT)",
    "group_size": "CAST(group_size AS BIGINT)", "page": "CAST(page AS BIGINT)",
    "avg_font_size": "avg_font_size", "max_font_size": "max_font_size", "font_std": "font_std",
    "font_ratio_to_body": "avg_font_size / most_common_font", "font_percentile": "font_percentile",
    "min_y_position": "min_y_position", "avg_y_position": "avg_y_position", "bold_ratio": "bold_ratio",
    "italic_ratio": "italic_ratio", "center_ratio": "center_ratio", "avg_caps_ratio": "avg_caps_ratio",
    "avg_indentation": "avg_indentation", "avg_spacing": "avg_spacing", "max_spacing": "max_spacing",
    "spacing_ratio": "avg_spacing / greatest(doc_avg_spacing, 1.0)", "is_grouped": "group_size > 1",
    "has_hyphen_split": "has_hyphen_split", "has_colon_split": "has_colon_split",
    "has_numbering": r"regexp_matches(text, '^\p{Nd}+\.?[\s\p{Z}]+')",
    "has_chapter_pattern": "regexp_matches(text, '(?i)chapter|section|part')",
    "starts_with_capital": r"regexp_matches(substr(text, 1, 1), '^\p{Lu}')",
    "sentence_count": "CAST(length(text) - length(replace(text, '.', '')) + length(text) - length(replace(text, '!', '')) + length(text) - length(replace(text, '?', '')) AS BIGINT)",
    "ends_with_period": "suffix(text, '.')",
    "has_special_chars": r"regexp_matches(text, '[^\p{L}\p{N}_\s\p{Z}.,\-:;!?]')",
    "is_very_short": f"{_WC} <= 3", "is_short": f"{_WC} <= 10", "is_medium": f"{_WC} > 10 AND {_WC} <= 30",
    "is_long": f"{_WC} > 30", "is_top_of_page": "min_y_position <= 0.1", "is_upper_half": "min_y_position <= 0.5",
    "is_first_page": "page = 1", "is_early_page": "page <= 2",
}
_DOUBLE_FEATS = {"avg_font_size", "max_font_size", "font_std", "font_ratio_to_body", "font_percentile",
                 "min_y_position", "avg_y_position", "bold_ratio", "italic_ratio", "center_ratio", "avg_caps_ratio",
                 "avg_indentation", "avg_spacing", "max_spacing", "spacing_ratio"}
FEATURES = list(_F12_SQL)


def _feat_sql(keys: list[str]) -> str:
    return ", ".join((sr6(_F12_SQL[k]) if k in _DOUBLE_FEATS else _F12_SQL[k]) + f" AS {k}" for k in keys)


def _feat_spark(keys: list[str]) -> list[Column]:
    fc = feature_columns()
    return [(r6(fc[k]) if k in _DOUBLE_FEATS else fc[k]).alias(k) for k in keys]


@register("f12_features", S2 + "SELECT doc_id, first_seq AS group_first_seq, " + _feat_sql(FEATURES) + " FROM gs")
def q_f12(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select("doc_id", F.col("first_seq").alias("group_first_seq"), *_feat_spark(FEATURES))


_F13 = ["has_numbering", "has_chapter_pattern", "starts_with_capital", "sentence_count", "ends_with_period",
        "has_special_chars"]


@register("f13_text_tests", S2 + "SELECT doc_id, first_seq AS group_first_seq, page AS group_page, " + _feat_sql(_F13) + " FROM gs")
def q_f13(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select("doc_id", F.col("first_seq").alias("group_first_seq"), F.col("page").alias("group_page"),
                    *_feat_spark(_F13))


@register("f14_penalties", S2 + f"""SELECT doc_id, page, first_seq,
  regexp_matches({O.strip('text')}, '^\\p{{Nd}}+[\\s\\p{{Z}}]*$') AS only_digits,
  contains(lower(text), 'page') AND {_WC} <= 3 AS page_word,
  length(text) > 200 AS too_long,
  length(text) - length(replace(text, '.', '')) > 3 AS many_dots FROM gs""")
def q_f14(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, *[c.alias(k) for k, c in S.penalties(F.col("text")).items()])


@register("f9_title_score", S2 + f"SELECT doc_id, page, first_seq, {sr6('CAST(score AS DOUBLE)')} AS score FROM sc")
def q_f9(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, r6("score").alias("score"))


@register("p19_title_candidates", S2 + "SELECT doc_id, count(*) AS n_candidates FROM sc WHERE length(text) >= 3 GROUP BY doc_id")
def q_p19(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return S.title_candidates(s).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_candidates"))


@register("a8_best_candidate", S2 + f"SELECT doc_id, best_text, {sr6('CAST(best_score AS DOUBLE)')} AS best_score FROM best")
def q_a8(spark, sf):
    best = S.best_titles(_corpus(spark, sf, with_requests=False).scored, cutoff=float("-inf"))
    return best.select("doc_id", F.col("title").alias("best_text"), r6("title_score").alias("best_score"))


@register("w5_title_rank", S2 + """SELECT doc_id, page, first_seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, first_y0, first_seq) AS INT) AS title_rank
FROM sc WHERE length(text) >= 3""")
def q_w5(spark, sf):
    s = S.title_candidates(_corpus(spark, sf, with_requests=False).scored)
    ranked = rank_within(s, ["doc_id"], "score", True, ["page", "first_y0", "first_seq"], rank_col="title_rank")
    return ranked.select(*_GKEY, "title_rank")


@register("f11_title_confidence", S2 + f"SELECT doc_id, {sr6('least(CAST(best_score AS DOUBLE) / 10.0, 1.0)')} AS title_confidence FROM best")
def q_f11(spark, sf):
    t = _corpus(spark, sf, with_requests=False).best_titles
    return t.select("doc_id", r6("title_confidence").alias("title_confidence"))


@register("ml10_titles", S2 + "SELECT doc_id, title FROM titles")
def q_ml10(spark, sf):
    return _corpus(spark, sf, with_requests=False).titles.select("doc_id", "title")


@register("f10_heading_levels", S2 + f"SELECT doc_id, page, first_seq, {O.heading_level_sql()} AS level FROM sc")
def q_f10(spark, sf):
    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, S.heading_level().alias("level"))


@register("j6_title_exclusion", S2 + """SELECT s.doc_id, count(*) AS n_groups,
  count(*) FILTER (WHERE s.text = coalesce(t.title, '') OR length(s.text) < 3) AS n_excluded
FROM sc s LEFT JOIN titles t USING (doc_id) GROUP BY s.doc_id""")
def q_j6(spark, sf):
    c = _corpus(spark, sf, with_requests=False).classified
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("excluded").alias("n_excluded"))


@register("ml9_rule_headings", S2 + "SELECT doc_id, page, first_seq, text, level, CAST(confidence AS DOUBLE) AS confidence FROM outline_rows")
def q_ml9(spark, sf):
    h = _corpus(spark, sf, with_requests=False).headings
    return h.select(*_GKEY, "text", "level", F.col("confidence").cast("double").alias("confidence"))


@register("a14_outline", S2 + """SELECT t.doc_id, t.title, CAST(count(o.doc_id) AS BIGINT) AS n_headings,
  coalesce(string_agg(o.level || '|' || CAST(o.page AS VARCHAR) || '|' || o.text, chr(10) ORDER BY o.page, o.first_y0, o.first_seq), '') AS outline_text
FROM titles t LEFT JOIN outline_rows o USING (doc_id) GROUP BY t.doc_id, t.title""")
def q_a14(spark, sf):
    o = _corpus(spark, sf, with_requests=False).outlines
    return o.select("doc_id", "title", F.size("outline").cast("long").alias("n_headings"),
                    F.array_join(F.transform("outline", lambda x: F.concat_ws("|", x["level"], x["page"].cast("string"), x["text"])),
                                 "\n").alias("outline_text"))


_COVER = """SELECT count(*) AS n_docs, {r6t} AS title_rate, {r6h} AS heading_rate FROM (
  SELECT t.doc_id, t.title, (SELECT count(*) FROM outline_rows o WHERE o.doc_id = t.doc_id) AS n FROM titles t {where})"""


def _cover_sql(where: str = "") -> str:
    return S2 + _COVER.format(r6t=sr6("avg(CASE WHEN title <> '' THEN 1.0 ELSE 0.0 END)"),
                              r6h=sr6("avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)"), where=where)


@register("a10_coverage", _cover_sql())
def q_a10(spark, sf):
    cov = S.outline_coverage(_corpus(spark, sf, with_requests=False).outlines)
    return cov.select("n_docs", r6("title_rate").alias("title_rate"), r6("heading_rate").alias("heading_rate"))


@register("src11_sample_coverage", _cover_sql("ORDER BY t.doc_id LIMIT 50"))
def q_src11(spark, sf):
    cov = S.outline_coverage(_corpus(spark, sf, with_requests=False).outlines, sample=50)
    return cov.select("n_docs", r6("title_rate").alias("title_rate"), r6("heading_rate").alias("heading_rate"))


@register("a13_multi_groups", S2 + "SELECT doc_id, count(*) AS n_groups, count(*) FILTER (WHERE group_size > 1) AS n_multi FROM grp GROUP BY doc_id")
def q_a13(spark, sf):
    g = _corpus(spark, sf, with_requests=False).groups
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("group_size") > 1).alias("n_multi"))


_LABELS_SQL = S2.rstrip("\n") + f""",
lab AS (
SELECT s.*, (b.best_score > 6.0 AND s.text = b.best_text) AS is_title
FROM sc s LEFT JOIN best b USING (doc_id))
"""


@register("ml1_weak_labels", _LABELS_SQL + f"""SELECT doc_id, page, first_seq, CAST(coalesce(is_title, false) AS INT) AS title_label,
  {O.heading_level_sql('coalesce(is_title, false)')} AS heading_label FROM lab""")
def q_ml1(spark, sf):
    from ..operators import model as M

    lab = M.weak_labels(_corpus(spark, sf, with_requests=False).scored)
    return lab.select(*_GKEY, "title_label", "heading_label")


@register("a9_class_weights", _LABELS_SQL + f""", hl AS (SELECT {O.heading_level_sql('coalesce(is_title, false)')} AS heading_label FROM lab)
SELECT heading_label, count(*) AS n, {sr6('CAST((SELECT count(*) FROM hl) AS DOUBLE) / ((SELECT count(DISTINCT heading_label) FROM hl) * count(*))')} AS weight
FROM hl GROUP BY heading_label""")
def q_a9(spark, sf):
    from ..operators import model as M

    lab = M.weak_labels(_corpus(spark, sf, with_requests=False).scored)
    w = M.class_weights(lab, "heading_label")
    return w.select("heading_label", "n", r6("weight").alias("weight"))


@register("ml3_label_index", _LABELS_SQL + f""", hl AS (SELECT DISTINCT {O.heading_level_sql('coalesce(is_title, false)')} AS heading_label FROM lab)
SELECT heading_label, CAST(row_number() OVER (ORDER BY heading_label) - 1 AS DOUBLE) AS label_index FROM hl""")
def q_ml3(spark, sf):
    from ..operators import model as M

    lab = M.weak_labels(_corpus(spark, sf, with_requests=False).scored)
    return M.label_index(lab)


@register("u3_label_counts", _LABELS_SQL + f"""SELECT doc_id, count(*) AS n_features,
  count(*) FILTER (WHERE {O.heading_level_sql('coalesce(is_title, false)')} <> 'body') AS n_labels FROM lab GROUP BY doc_id""")
def q_u3(spark, sf):
    from ..operators import model as M

    lab = M.weak_labels(_corpus(spark, sf, with_requests=False).scored)
    return lab.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("heading_label") != "body").alias("n_labels"))


# ---------------------------------------------------------------- stage 3

S3 = O.chain(*O.STAGE3)


@register("j1_requested_outlines", S3 + """SELECT j.request_id, CAST(j.doc_pos AS BIGINT) AS doc_pos, j.doc_id, t.title,
  CAST((SELECT count(*) FROM outline_rows o WHERE o.doc_id = j.doc_id) AS BIGINT) AS n_headings
FROM jd j JOIN titles t USING (doc_id)""")
def q_j1(spark, sf):
    c = _corpus(spark, sf)
    j = R.join_outlines(c.request_docs, c.docs)
    n = c.headings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return j.join(c.titles.select("doc_id", "title"), "doc_id").join(n, "doc_id", "left").select(
        "request_id", F.col("doc_pos").cast("long").alias("doc_pos"), "doc_id", "title",
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_headings"))


@register("j2_missing_documents", S3 + "SELECT request_id, filename FROM rd WHERE doc_key NOT IN (SELECT doc_key FROM jd)")
def q_j2(spark, sf):
    c = _corpus(spark, sf)
    return R.missing_documents(c.request_docs, c.docs).select("request_id", "filename")


@register("a12_text_content", S2 + "SELECT doc_id, string_agg(text, chr(10) ORDER BY page, first_y0, first_seq) AS content FROM outline_rows GROUP BY doc_id")
def q_a12(spark, sf):
    return R.text_content(_corpus(spark, sf, with_requests=False).headings)


@register("p20_content_filter", S2 + f"SELECT doc_id, bool_or({O.strip('text')} <> '') AS has_content FROM outline_rows GROUP BY doc_id")
def q_p20(spark, sf):
    return R.has_content(_corpus(spark, sf, with_requests=False).headings)


@register("ml12_section_scores", S3 + f"SELECT request_id, doc_id, page, first_seq, {sr6('score')} AS score FROM bm")
def q_ml12(spark, sf):
    c = _corpus(spark, sf)
    rd = R.join_outlines(c.request_docs, c.docs)
    s = R.bm25_sections(c.requests, rd, c.headings)
    return s.select("request_id", "doc_id", "page", "first_seq", r6("score").alias("score"))


@register("o4_top2_per_doc", S3 + "SELECT request_id, doc_id, importance_rank, section_title, page_number FROM cand WHERE NOT is_fallback")
def q_o4(spark, sf):
    c = _corpus(spark, sf)
    return c.candidates.filter(~F.col("is_fallback")).select(
        "request_id", "doc_id", F.col("importance_rank").cast("int").alias("importance_rank"), "section_title",
        F.col("page_number").cast("int").alias("page_number"))


@register("f6_fallback_sections", S3 + "SELECT request_id, doc_id, section_title, importance_rank, page_number FROM fb")
def q_f6(spark, sf):
    c = _corpus(spark, sf)
    return c.candidates.filter("is_fallback").select(
        "request_id", "doc_id", "section_title", F.col("importance_rank").cast("int").alias("importance_rank"),
        F.col("page_number").cast("int").alias("page_number"))


@register("o3_w6_top_sections", S3 + "SELECT request_id, importance_rank, section_title, CAST(page_number AS INT) AS page_number, filename AS document FROM kept")
def q_o3(spark, sf):
    k = _corpus(spark, sf).kept
    return k.select("request_id", F.col("importance_rank").cast("int").alias("importance_rank"), "section_title",
                    F.col("page_number").cast("int").alias("page_number"), F.col("filename").alias("document"))


@register("j7_ml13_refined_text", S3 + "SELECT request_id, importance_rank, filename AS document, refined_text FROM kt")
def q_j7(spark, sf):
    k = _corpus(spark, sf).kept_with_text
    return k.select("request_id", F.col("importance_rank").cast("int").alias("importance_rank"),
                    F.col("filename").alias("document"), "refined_text")


@register("f7_fallback_text", S3 + "SELECT request_id, filename AS document, refined_text FROM kt WHERE is_fallback")
def q_f7(spark, sf):
    k = _corpus(spark, sf).kept_with_text.filter("is_fallback")
    return k.select("request_id", F.col("filename").alias("document"), "refined_text")


@register("f4_ws_collapse", r"""SELECT doc_id, CAST(length(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS BIGINT) AS n_collapsed,
  CAST(len(string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ')) AS BIGINT) AS n_pieces FROM documents""")
def q_f4(spark, sf):
    from ..sources.tables import table

    d = table(spark, sf, "documents").select("doc_id", collapse_ws(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_collapsed"),
                    F.size(F.split("t", " ")).cast("long").alias("n_pieces"))


@register("f8_prompts", S3 + """, ctext AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, first_y0, first_seq) AS content FROM outline_rows GROUP BY doc_id)
SELECT j.request_id, j.doc_id,
  'You are a ' || r.persona || '. Your task is: ' || r.task || chr(10) || chr(10) || 'Find in the document "' || j.filename
  || '" the 1-2 sections most relevant to the task.' || chr(10) || chr(10) || 'Document content:' || chr(10) || c.content || chr(10) || chr(10)
  || 'Answer with a JSON array of objects with section_title, importance_rank, page_number.' AS prompt
FROM jd j JOIN ctext c USING (doc_id) JOIN fx_requests r USING (request_id)
WHERE """ + O.strip("c.content") + " <> ''")
def q_f8(spark, sf):
    c = _corpus(spark, sf)
    return R.prompts(c.requests, c.request_docs, c.docs, c.headings).select("request_id", "doc_id", "prompt")


@register("ml14_answers", S3 + """SELECT r.request_id, CAST(count(k.request_id) AS BIGINT) AS n_sections,
  coalesce(string_agg(CAST(k.importance_rank AS VARCHAR) || '|' || k.section_title || '|' || CAST(k.page_number AS VARCHAR) || '|' || k.filename || '|' || k.refined_text, chr(10) ORDER BY k.importance_rank), '') AS sections
FROM fx_requests r LEFT JOIN kt k USING (request_id) GROUP BY r.request_id""")
def q_ml14(spark, sf):
    a = _corpus(spark, sf).answers()
    line = lambda x, y: F.concat_ws("|", x["importance_rank"].cast("string"), x["section_title"],
                                    x["page_number"].cast("string"), x["document"], y["refined_text"])
    return a.select(
        "request_id", F.size("extracted_sections").cast("long").alias("n_sections"),
        F.array_join(F.zip_with("extracted_sections", "subsection_analysis", line), "\n").alias("sections"))


@register("snk3_answer_metadata", S3 + """SELECT r.request_id,
  (SELECT string_agg(filename, chr(10) ORDER BY doc_pos) FROM fx_request_docs d WHERE d.request_id = r.request_id) AS input_documents,
  r.persona, r.task AS job_to_be_done,
  CAST((SELECT count(*) FROM kt k WHERE k.request_id = r.request_id) AS BIGINT) AS n_extracted
FROM fx_requests r""")
def q_snk3(spark, sf):
    a = _corpus(spark, sf).answers()
    return a.select("request_id", F.array_join("metadata.input_documents", "\n").alias("input_documents"),
                    F.col("metadata.persona").alias("persona"), F.col("metadata.job_to_be_done").alias("job_to_be_done"),
                    F.size("extracted_sections").cast("long").alias("n_extracted"))


@register("snk6_summary", S3 + "SELECT request_id, CAST(importance_rank AS VARCHAR) || '. ' || section_title || ' (' || filename || ')' AS line FROM kept")
def q_snk6(spark, sf):
    k = _corpus(spark, sf).kept
    return k.select("request_id", F.format_string("%d. %s (%s)", F.col("importance_rank").cast("int"),
                                                  F.col("section_title"), F.col("filename")).alias("line"))


_fits: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf):
    """One fit per session and table for the queries that need a model."""
    from ..operators import model as M

    at = (spark.sparkContext.applicationId, sf)
    if at not in _fits:
        c = _corpus(spark, sf, with_requests=False)
        _fits[at] = (*M.fit_structure_model(M.weak_labels(c.scored)), c)
    return _fits[at]


@register("ml7_train_accuracy")
def q_ml7(spark, sf):
    """ML2-ML7 + A11 (rows only), with the default parameters."""
    from ..operators import model as M

    model, test, _ = _fitted(spark, sf)
    return M.accuracy(model, test)


@register("ml8_model_headings")
def q_ml8(spark, sf):
    """The model's headings, through the outline stage."""
    model, _, c = _fitted(spark, sf)
    c.model = model
    return c.headings.select("doc_id", "page", "first_seq", "text", "level")


_J3_EXACT = S1.rstrip("\n") + ",\n" + O.FX_TOC_LINES + f""",
toc_e AS (
SELECT DISTINCT doc_id, {O.strip("regexp_extract(" + O.strip("line") + f", '{_TOC_PAT}', 1)")} AS entry
FROM fx_toc_lines WHERE page <= 3 AND regexp_matches({O.strip("line")}, '{_TOC_PAT}'))
SELECT DISTINCT b.doc_id, b.page, b.block_seq FROM blk b JOIN toc_e e ON e.doc_id = b.doc_id AND e.entry = {O.strip("b.text")}"""


@register("j3_exact_toc_matches", _J3_EXACT)
def q_j3_exact(spark, sf):
    """J3, exact-equal subset (ratio 1): blocks whose text equals a TOC
    entry of their document, through the same length-band candidate join."""
    blk = _corpus(spark, sf, with_requests=False).blocks
    entries = TOC.toc_entries(fixtures.fx_toc_lines(spark, sf))
    m = TOC.toc_matches(blk, entries)
    return m.filter(F.col("best_ratio") >= 1.0).select("doc_id", "page", "block_seq")


# ------------------------------------------------- model answers, requests, split

_RESPONSE = """CASE doc_id % 5 WHEN 0 THEN 'Sure: [{"section_title": "S' || doc_id || '", "importance_rank": 1, "page_number": 2}, {"section_title": "T", "importance_rank": 2, "page_number": 3}] done'
  WHEN 1 THEN '["plain", {"section_title": "U", "importance_rank": "3", "page_number": 1}, 7]'
  WHEN 2 THEN 'no array for ' || source WHEN 3 THEN '[]' ELSE '[{"section_title": ' END"""
_RESPONSES = f"""resp AS (
SELECT doc_id % 40 AS request_id, doc_id, CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN ' Cities.pdf' ELSE ' tips.pdf' END AS filename, CAST(doc_id AS INT) AS doc_pos, {_RESPONSE} AS response
FROM documents),
els AS (
SELECT doc_id, json_extract(e, '$[*]') AS a FROM (
  SELECT doc_id, CASE WHEN json_valid(regexp_extract(response, '(?s)\\[.*?\\]')) THEN CAST(regexp_extract(response, '(?s)\\[.*?\\]') AS JSON) END AS e FROM resp) WHERE e IS NOT NULL),
objs AS (SELECT doc_id, list_filter(a, lambda x: json_type(x) = 'OBJECT') AS o FROM els),
ms AS (
SELECT doc_id, i AS pos, o[i] ->> 'section_title' AS section_title, TRY_CAST(o[i] ->> 'importance_rank' AS INT) AS importance_rank, TRY_CAST(o[i] ->> 'page_number' AS INT) AS page_number
FROM (SELECT doc_id, o, unnest(range(1, len(o) + 1)) AS i FROM objs))"""


def _responses(spark, sf):
    from ..sources.tables import table

    return table(spark, sf, "documents").selectExpr(
        "doc_id % 40 AS request_id", "doc_id",
        "concat(cast(doc_id AS string), CASE WHEN doc_id % 3 = 0 THEN ' Cities.pdf' ELSE ' tips.pdf' END) AS filename",
        "cast(doc_id AS int) AS doc_pos", _RESPONSE + " AS response")


@register("f5_model_sections", "WITH " + _RESPONSES + """
SELECT doc_id, pos, section_title, importance_rank, page_number FROM ms""")
def q_f5(spark, sf):
    """Objects of the JSON array in each response; a rank given as text counts."""
    r = _responses(spark, sf).select("doc_id", F.posexplode(R.parse_model_sections(F.col("response"))).alias("i", "s"))
    return r.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "s.section_title", "s.importance_rank", "s.page_number")


@register("p21_section_check", "WITH " + _RESPONSES + """
SELECT r.doc_id, o.doc_id IS NOT NULL AS is_list, CAST(coalesce(len(o.o), 0) AS BIGINT) AS n_objects FROM resp r LEFT JOIN objs o USING (doc_id)""")
def q_p21(spark, sf):
    s = R.parse_model_sections(F.col("response"))
    return _responses(spark, sf).select("doc_id", s.isNotNull().alias("is_list"),
                                        F.coalesce(F.when(s.isNotNull(), F.size(s)), F.lit(0)).cast("long").alias("n_objects"))


@register("ud1_hook_answers", "WITH " + _RESPONSES + """,
c AS (
SELECT r.request_id, r.filename, r.doc_pos, m.pos, m.section_title, m.importance_rank, m.page_number FROM resp r JOIN ms m USING (doc_id)
UNION ALL
SELECT r.request_id, r.filename, r.doc_pos, 1, CASE WHEN contains(lower(r.filename), 'cities') THEN 'Major Cities Guide' ELSE 'Travel Tips' END,
  CASE WHEN contains(lower(r.filename), 'cities') THEN 1 ELSE 4 END, 1 FROM resp r WHERE r.doc_id NOT IN (SELECT doc_id FROM objs)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY importance_rank NULLS LAST, doc_pos, pos) AS INT) AS r FROM c)
SELECT k.request_id, k.r AS importance_rank, k.section_title, k.page_number, k.filename AS document,
  'This section from ' || k.filename || ' is relevant to the task: ' || q.task AS refined_text
FROM k JOIN (SELECT item_id AS request_id, text AS task FROM benchmark) q USING (request_id) WHERE r <= 5""")
def q_ud1(spark, sf):
    """Responses of a model through ranking and texts to answers."""
    reqs = fixtures.fx_requests(spark, sf)
    kept = R.top_sections(R.parsed_sections(_responses(spark, sf)).drop("from_model"))
    empty = spark.createDataFrame([], "doc_id long, section struct<page:int,first_y0:double,first_seq:int>, "
                                      "first_y0 double, first_seq int, page int, text string")
    t = R.refined_texts(kept, reqs, empty).join(reqs.select("request_id"), "request_id")
    return t.select("request_id", F.col("importance_rank").cast("int").alias("importance_rank"), "section_title",
                    F.col("page_number").cast("int").alias("page_number"), F.col("filename").alias("document"), "refined_text")


@register("ml4_split", S2 + """SELECT doc_id, page, first_seq,
  CAST('0x' || substr(md5('42:' || doc_id || ':' || page || ':' || first_seq), 1, 7) AS BIGINT) / 268435456.0 < 0.2 AS held_out FROM sc""")
def q_ml4(spark, sf):
    from ..operators import model as M

    s = _corpus(spark, sf, with_requests=False).scored
    return s.select(*_GKEY, (M.split_share() < M.TEST_FRACTION).alias("held_out"))


_SAMPLE = 100


@register("ml5_fit_sample", _LABELS_SQL + f""", hl AS (SELECT doc_id, page, first_seq, {O.heading_level_sql('coalesce(is_title, false)')} AS heading_label FROM lab),
ranked AS (SELECT *, row_number() OVER (PARTITION BY heading_label ORDER BY md5('fit 42:' || doc_id || ':' || page || ':' || first_seq), doc_id, page, first_seq) AS r FROM hl)
SELECT doc_id, page, first_seq, heading_label FROM ranked WHERE r <= {_SAMPLE}""")
def q_ml5_sample(spark, sf):
    """The sampling operator of the fit: so many rows of each class."""
    from ..operators import model as M

    lab = M.weak_labels(_corpus(spark, sf, with_requests=False).scored)
    return M.stratified_sample(lab, "heading_label", _SAMPLE).select(*_GKEY, "heading_label")
