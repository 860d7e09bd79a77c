"""SRC4: the text under a page's links, as a rectangle-overlap join.

The page is cut into grid cells; a rectangle (link or span) is copied to
the cells it touches and both sides meet by (doc_id, page, cell). Overlap
is tested exactly on the coordinates. A pair that shares several cells
counts in its owner cell only, the one of the upper left corner of the
common area, so that no distinct is needed. Work follows the number of
rectangles that lie near each other, not links x spans of a page, and a
page of many spans is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the kind of a link to a URI.
URI_LINK = 1
#: Cell of the grid in points: some words wide, about a line high.
CELL_WIDTH, CELL_HEIGHT = 96.0, 24.0
BOX = ("x0", "y0", "x1", "y1")


def uri_links(links: DataFrame, kind: int = URI_LINK) -> DataFrame:
    return links.filter(F.col("kind") == kind)


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _in_cells(df: DataFrame, prefix: str, width: float, height: float) -> DataFrame:
    """A row for each cell that the rectangle touches; empty, inverted and
    incomplete rectangles overlap nothing and have none."""
    x0, y0, x1, y1 = (F.col(prefix + c) for c in BOX)
    real = df.filter((x0 < x1) & (y0 < y1) & ~F.isnan(x1) & ~F.isnan(y1))
    return real.withColumn("cx", F.explode(F.sequence(_cell(x0, width), _cell(x1, width)))).withColumn(
        "cy", F.explode(F.sequence(_cell(y0, height), _cell(y1, height))))


def overlaps(links: DataFrame, spans: DataFrame, width: float = CELL_WIDTH, height: float = CELL_HEIGHT) -> DataFrame:
    """Every (link, span) of a page whose rectangles have a common area, once:
    doc_id, page, link_seq, block_seq, line_seq, span_seq, text."""
    a = links.select("doc_id", "page", "link_seq", *[F.col(c).cast("double").alias("l" + c) for c in BOX])
    b = spans.select("doc_id", "page", "block_seq", "line_seq", "span_seq", "text", *[F.col(c).cast("double").alias("s" + c) for c in BOX])
    pairs = _in_cells(a, "l", width, height).join(_in_cells(b, "s", width, height), ["doc_id", "page", "cx", "cy"])
    meet = (F.col("lx0") < F.col("sx1")) & (F.col("sx0") < F.col("lx1")) & (F.col("ly0") < F.col("sy1")) & (F.col("sy0") < F.col("ly1"))
    owner = (F.col("cx") == _cell(F.greatest("lx0", "sx0"), width)) & (F.col("cy") == _cell(F.greatest("ly0", "sy0"), height))
    return pairs.filter(meet & owner).select("doc_id", "page", "link_seq", "block_seq", "line_seq", "span_seq", "text")


def link_texts(links: DataFrame, spans: DataFrame, kind: int = URI_LINK,
               width: float = CELL_WIDTH, height: float = CELL_HEIGHT) -> DataFrame:
    """D3: the links of a kind with the text under their rectangle: the spans
    that overlap it, in reading order, those of a line joined, lines apart by
    a line feed; '' when there is none."""
    wanted = uri_links(links, kind)
    found = overlaps(wanted, spans, width, height)
    key = ["doc_id", "page", "link_seq"]
    by_line = found.groupBy(*key, "block_seq", "line_seq").agg(
        F.sort_array(F.collect_list(F.struct("span_seq", "text"))).alias("s"))
    by_line = by_line.select(*key, "block_seq", "line_seq", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("line"))
    texts = by_line.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_seq", "line_seq", "line"))), lambda x: x["line"]), "\n").alias("link_text"),
        F.sum("n").alias("n_spans"))
    rect = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("rect")
    return wanted.select(*key, "uri", rect).join(texts, key, "left").select(
        *key, "uri", "rect", F.coalesce("link_text", F.lit("")).alias("link_text"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))
