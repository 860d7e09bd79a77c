"""Fixture views V0-V5 (FIXTURES.md section 3) as DataFrames.

They turn the driver's ``documents`` / ``pages`` / ``benchmark`` tables into
the layout schemas the engine consumes, with the same rows DuckDB computes
from the SQL in FIXTURES.md. Every value derives from the given tables, so
the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table

# Fixed values of the fixture rule set (FIXTURES.md V0, V2).
LINES_PER_PAGE = 12
HTML_SPAN_PATTERN = r"<(title|h1|p|li|a|b|div|footer)(?: [^>]*)?>([^<]+)"
HTML_LINK_PATTERN = r'<a href="([^"]*)">([^<]*)'
HTML_TAG_SIZES = {"title": 24.0, "h1": 20.0, "b": 14.0, "p": 11.0, "li": 10.0,
                  "a": 10.0, "div": 10.0, "footer": 9.0}
HTML_BOLD_TAGS = ("title", "h1", "b")


def _mod(n: Column, k: int) -> Column:
    return (n % k) == 0


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V0: each non-blank line of a document is one layout block."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    lines = docs.select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).filter(F.length(F.trim("line")) > 0)
    n = F.length("line")
    ln = F.col("line_no")
    base_size = (
        F.when(ln == 0, 20.0).when(_mod(n, 7), 14.0).when(_mod(n, 5), 12.0)
        .when(_mod(n, 4), 13.0).otherwise(11.0)
    )
    font = (
        F.when(ln == 0, "Helvetica-Bold").when(_mod(n, 7), "Times-Bold")
        .when(_mod(n, 13), "Arial-Black").when(_mod(n, 11), "Times-Italic")
        .when(_mod(n, 17), "Courier").when(_mod(n, 19), "Helvetica-LightOblique")
        .otherwise("Helvetica")
    )
    flags = (
        F.when(_mod(n, 23), 16).when(_mod(n, 29), 2).when(_mod(n, 31), 8)
        .when(_mod(n, 37), 32).otherwise(0)
    )
    color = F.when(_mod(n, 7), 2051705).otherwise(0)
    row = ln % LINES_PER_PAGE
    return lines.select(
        "doc_id", "lang",
        ln.cast("int").alias("block_seq"),
        (F.floor(ln / LINES_PER_PAGE).cast("int") + 1).alias("page"),
        "line",
        n.alias("n"),
        base_size.cast("double").alias("base_size"),
        font.alias("font"),
        flags.cast("int").alias("flags"),
        color.cast("int").alias("color"),
        (72 + (n % 4) * 18).cast("double").alias("bx0"),
        (40 + row * 56).cast("double").alias("by0"),
        (540 - (n % 2) * 30).cast("double").alias("bx1"),
        (40 + row * 56 + 52 - (n % 3) * 4).cast("double").alias("by1"),
        F.lit(612.0).alias("page_width"),
        F.lit(792.0).alias("page_height"),
    )


def fx_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: D1 spans; each line cut at ', ' into spans, size alternates +0.5."""
    lines = fx_lines(spark, sf_dir)
    return lines.select(
        "*", F.posexplode(F.split("line", ", ")).alias("span_seq", "text")
    ).select(
        "doc_id", "lang", "page", "block_seq",
        F.lit(0).alias("line_seq"),
        F.col("span_seq").cast("int").alias("span_seq"),
        "text", "font",
        (F.col("base_size") + (F.col("span_seq") % 2).cast("double") / 2).alias("size"),
        "flags", "color", "bx0", "by0", "bx1", "by1", "page_width", "page_height",
    )


def fx_html_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: markup re-aimed as layout; the tag plays the role of the font."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    pat = F.lit(HTML_SPAN_PATTERN)
    arrs = pages.select(
        "page_id",
        F.regexp_extract_all("html", pat, F.lit(1)).alias("g"),
        F.regexp_extract_all("html", pat, F.lit(2)).alias("t"),
    )
    return arrs.select(
        "page_id", F.posexplode(F.arrays_zip("g", "t")).alias("span_seq", "z")
    ).select(
        "page_id",
        F.col("span_seq").cast("int").alias("span_seq"),
        F.col("z.g").alias("tag"),
        F.col("z.t").alias("text"),
    )


def html_tag_size(tag: Column) -> Column:
    expr = None
    for name, size in HTML_TAG_SIZES.items():
        expr = (F.when(tag == name, size) if expr is None else expr.when(tag == name, size))
    return expr.otherwise(None).cast("double")


def fx_toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: all text lines on their pages, some of them dot-leader TOC
    entries; every second one of these without its letters e."""
    lines = fx_lines(spark, sf_dir)
    n = F.col("n")
    body = F.when(_mod(n, 14), F.replace("line", F.lit("e"), F.lit(""))).otherwise(F.col("line"))
    entry = F.concat(body, F.lit(" ..... "),
                     F.col("page").cast("string"))
    line = F.when((F.col("block_seq") == 0) | _mod(n, 7), entry).otherwise(F.col("line"))
    return lines.select(
        "doc_id", "page", F.col("block_seq").alias("line_no"), line.alias("line")
    )


def fx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: one request per benchmark item; the item text is the task."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"), F.lit("Analyst").alias("persona"),
        F.col("text").alias("task"),
    )


def fx_request_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the documents named by each request, in request order. Item k of
    n names the documents with doc_id % n = k, so that each is named once
    and the table grows with the documents; every seventh name has no
    document."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "benchmark").select("item_id")
    b = items.select(F.col("item_id").alias("request_id"),
                     (F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"))
    n = items.count()  # one number
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % max(n, 1)).alias("k"))
    w = Window.partitionBy("request_id").orderBy("doc_id")
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("missing "), i)).otherwise(i)
    return b.join(d, "k").select(
        "request_id", "doc_id", F.concat(name, F.lit(".pdf")).alias("filename"),
        F.row_number().over(w).alias("doc_pos"),
    )


def fx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: D3 links from markup (uri and link text)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    pat = F.lit(HTML_LINK_PATTERN)
    arrs = pages.select(
        "page_id",
        F.regexp_extract_all("html", pat, F.lit(1)).alias("u"),
        F.regexp_extract_all("html", pat, F.lit(2)).alias("t"),
    )
    return arrs.select(
        "page_id", F.posexplode(F.arrays_zip("u", "t")).alias("link_seq", "z")
    ).select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("page"),
        F.col("link_seq").cast("int").alias("link_seq"),
        F.col("z.u").alias("uri"), F.col("z.t").alias("link_text"),
    )


def fx_span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the spans with a rectangle each, side by side on their line."""
    s = fx_spans(spark, sf_dir)
    return s.select("doc_id", "page", "block_seq", "line_seq", "span_seq", "text",
                    (F.col("bx0") + F.col("span_seq") * 80).alias("x0"), F.col("by0").alias("y0"),
                    (F.col("bx0") + F.col("span_seq") * 80 + 72).alias("x1"), F.col("by1").alias("y1"))


def fx_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: links with kind and rectangle; one at every line of a length
    divisible by 5, over parts of some lines, every second one of another kind."""
    lines = fx_lines(spark, sf_dir).filter(_mod(F.col("n"), 5))
    n = F.col("n")
    x0 = (60 + (n % 11) * 40).cast("double")
    y0 = F.col("by0") - (n % 3) * 30
    return lines.select(
        "doc_id", "page", F.col("block_seq").alias("link_seq"), (1 + (n % 2)).cast("int").alias("kind"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("block_seq").cast("string")).alias("uri"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + (n % 7) * 60).alias("x1"), (y0 + 16 + (n % 4) * 40).alias("y1"))


def fx_spans_with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the spans, and for every line of a length divisible by 6 a second
    block whose spans hold white space only."""
    s = fx_spans(spark, sf_dir)
    blank = fx_lines(spark, sf_dir).filter(_mod(F.col("n"), 6)).select("doc_id", "block_seq").distinct()
    again = s.join(blank, ["doc_id", "block_seq"]).withColumn("block_seq", F.col("block_seq") + 1000000).withColumn("text", F.lit(" \t "))
    return s.unionByName(again)


def fx_block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: a block file of each document as a row (doc_key, value): a JSON array
    with an element per line, some of them odd; some files cut off, objects, or empty."""
    lines = fx_lines(spark, sf_dir)
    n, seq = F.col("n").cast("string"), F.col("block_seq")
    text = F.regexp_replace("line", "[^A-Za-z0-9 ]", "")
    page = F.when(_mod(F.col("n"), 3), F.concat(F.lit('"'), F.col("page").cast("string"), F.lit('"'))).when(
        _mod(F.col("n"), 8), F.lit("[1]")).otherwise(F.col("page").cast("string"))
    size = F.when(_mod(F.col("n"), 9), F.lit('"big"')).when(_mod(F.col("n"), 10), F.lit("null")).otherwise(n)
    element = F.when(_mod(F.col("n"), 13), F.lit("7")).otherwise(F.concat(
        F.lit('{"page": '), page, F.lit(', "avg_font_size": '), size, F.when(_mod(F.col("n"), 4), F.lit("")).otherwise(
            F.concat(F.lit(', "text": "'), text, F.lit('"'))), F.lit("}")))
    files = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq.alias("s"), element.alias("e")))),
                                                                 lambda x: x["e"]), ", ").alias("body"))
    d = F.col("doc_id") % 11
    whole = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    value = F.when(d == 0, F.concat(F.lit("["), F.col("body"))).when(d == 1, F.lit('{"page": 1}')).when(d == 2, F.lit("[]")).when(
        d == 3, F.lit(" ")).otherwise(whole)
    return files.select(F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("doc_key"), value.alias("value"))
