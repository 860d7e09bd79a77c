"""Stage 1: layout spans -> ordered, merged layout blocks with features.

Plan: spans are shuffled once by (doc_id, page); span -> block assembly
(A1), the y-ordered lag (W1) and the merge fold (W3) all reuse that
partitioning. Document-level statistics (A2 median size, A3 dominant font)
are partial aggregates by doc_id (one small row per document), dealt to the
document's pages and joined there onto the merged blocks, so a very large
document never has to sit in one task and no block is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fonts
from ..functions.counts import counted, text_counts
from ..functions.readability import readability
from ..functions.text import (NOT_BLANK, is_title_case, starts_with_bullet, starts_with_numbering, strip,
                              upper_count, word_count)
from . import folds
from .scan import percentiles_of, running

# Fixed values (reference rule set).
HEADER_FRACTION = 0.1
FOOTER_FRACTION = 0.9
CENTER_TOLERANCE = 100.0
BLACK_TEXT_MAX = 50
SHORT_WORDS = 10


def span_doc_stats(spans: DataFrame) -> DataFrame:
    """A2 + A3: median span size and dominant font of each document.

    The median is exact (``scan.percentiles_of``: counts of distinct sizes, and a
    selection by ranges where a document has very many). The mode breaks
    ties by first appearance in source order (page, block, line, span).
    Both read one written table of a document's fonts and sizes, so that the
    spans are scanned once."""
    from ..plans.pipeline import write_stage

    first = F.min(F.struct("page", "block_seq", "line_seq", "span_seq")).alias("first")
    kinds = write_stage(spans.groupBy("doc_id", "font", "size").agg(F.count(F.lit(1)).alias("cnt"), first))
    sizes = kinds.filter(F.col("size").isNotNull()).groupBy("doc_id", F.col("size").alias("v")).agg(F.sum("cnt").alias("c"))
    med = percentiles_of(write_stage(sizes), ["doc_id"], [0.5]).select("doc_id", F.col("pct")[0].alias("median_font_size"))
    per_font = kinds.groupBy("doc_id", "font").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"))
    dom = per_font.groupBy("doc_id").agg(
        F.min_by("font", F.struct((-F.col("cnt")).alias("c"), F.col("first"))).alias("dominant_font")
    )
    return dom.join(med, "doc_id", "left")


def assemble_blocks(spans: DataFrame) -> DataFrame:
    """A1 + P1: one row per non-blank block; spans are ordered by
    (line_seq, span_seq). Output is hash-partitioned by (doc_id, page)."""
    styles = fonts.font_styles(F.col("font_lc"), F.col("flags"), lowered=True)
    # in a shuffled row what the spans of a block have in common comes first: it compresses as one run
    s = spans.select(
        "doc_id", "page", "block_seq", "line_seq", "flags", "color", "bx0", "by0", "bx1", "by1",
        "page_width", "page_height", "font", "size", "span_seq", "text",
    ).repartition("doc_id", "page").withColumn("font_lc", F.lower(F.coalesce("font", F.lit(""))))
    # one integer for all flags: an aggregate each would be a buffer field and an update a span
    bits = sum((F.when(styles[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(schemas.STYLE_COLUMNS)), F.lit(0))
    strike = F.when(fonts.bit(F.col("flags"), fonts.FLAG_STRIKE), F.lit(1 << len(schemas.STYLE_COLUMNS))).otherwise(F.lit(0))
    s = s.withColumn("style_bits", bits + strike)
    # the ordered spans give text, first font and last color: an aggregate by least struct would sort wide rows
    raw = s.groupBy("doc_id", "page", "block_seq").agg(
        F.sort_array(F.collect_list(F.struct("line_seq", "span_seq", "text", "font", "color", "flags"))).alias("spans"),
        F.avg("size").alias("avg_font_size"),
        F.bit_or("style_bits").alias("style_bits"),
        *[F.min(c).alias(c) for c in ("bx0", "by0", "bx1", "by1", "page_width", "page_height")],
    )
    raw = raw.filter(F.exists("spans", lambda x: x["text"].rlike(NOT_BLANK)))
    first, last = F.element_at("spans", 1), F.element_at("spans", -1)
    raw = raw.withColumn("text_raw", F.concat(F.array_join(F.col("spans.text"), " "), F.lit(" "))).select(
        "*", first["font"].alias("font_name"), last["color"].alias("last_color"), last["flags"].alias("last_flags"),
        *[fonts.bit(F.col("style_bits"), 1 << i).alias(c) for i, c in enumerate([*schemas.STYLE_COLUMNS, "is_strikethrough"])],
    ).drop("spans", "style_bits")
    return raw.withColumn("text", strip(F.col("text_raw")))


def with_spacing(blocks: DataFrame) -> DataFrame:
    """W1 (+ O1): spacing_above = y0 - y1 of the block before it on the page
    (stable y0 order) when that y1 > 0, else 0."""
    w = folds.page_window(["y0", "block_seq"])
    prev = F.lag("y1").over(w)
    return blocks.withColumn(
        "spacing_above", F.when(prev > 0, F.col("y0") - prev).otherwise(F.lit(0.0))
    )


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """Packed 0xRRGGBB -> r, g, b."""
    c = F.coalesce(color, F.lit(0))
    return (F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255))


def block_features(b: DataFrame) -> dict[str, Column]:
    """P2-P7, P11-P16, F1 on one block (anchor text = own text, stripped ``text_raw``:
    words, capitals and title case are the same in both)."""
    text = F.col("anchor_text")
    text_raw = F.col("text_raw")
    counts = text_counts(text)
    r, g, bl = rgb(F.col("last_color"))
    feats = {
        "text_color_r": r.cast("int"),
        "text_color_g": g.cast("int"),
        "text_color_b": bl.cast("int"),
        "is_black_text": (r < BLACK_TEXT_MAX) & (g < BLACK_TEXT_MAX) & (bl < BLACK_TEXT_MAX),
        "is_underlined": fonts.bit(F.col("last_flags"), fonts.FLAG_UNDERLINE),
        "indentation_ratio": F.col("bx0") / F.col("page_width"),
        "is_header": (F.col("by0") / F.col("page_height")) < HEADER_FRACTION,
        "is_footer": (F.col("by1") / F.col("page_height")) > FOOTER_FRACTION,
        "caps_ratio": counted(counts, "n_upper", upper_count(text)) / F.greatest(F.length(text_raw), F.lit(1)),
        "is_title_case": is_title_case(text),
        "is_short": counted(counts, "n_words", word_count(text)) < SHORT_WORDS,
        "starts_with_numbering": starts_with_numbering(text),
        "is_center_aligned": F.abs(F.col("bx0") - (F.col("page_width") - F.col("bx1"))) < CENTER_TOLERANCE,
        "y_position_relative": F.col("by0") / F.col("page_height"),
        "is_bullet_point": starts_with_bullet(text),
    }
    feats.update(readability(text, counts))
    return feats


RAW_PAYLOAD = [
    "text_raw", "font_name", "last_color", "last_flags", "is_strikethrough",
    *[c for c in schemas.STYLE_COLUMNS if c not in ("is_bold", "is_italic")],
    "bx0", "bx1", "by1", "page_width", "page_height",
]


def raw_blocks(spans: DataFrame) -> DataFrame:
    """Blocks before the merge: A1, P1, W1; y0 = block top."""
    b = assemble_blocks(spans).withColumnRenamed("by0", "y0").withColumnRenamed("by1", "y1")
    return with_spacing(b).withColumnRenamed("y1", "by1").withColumn("by0", F.col("y0"))


def blocks_from_spans(spans: DataFrame, toc_lines: DataFrame | None = None,
                      language_profiles: DataFrame | None = None,
                      cluster_columns: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """D2 block records (plus doc_id, block_seq, y0) from D1 spans.
    ``keep`` names extra engine columns to keep (e.g. ``anchor_text``, the
    merged block's own first text, which language detection reads).

    ``toc_lines`` (doc_id, page, line_no, line) adds in_TOC_flag (J3);
    ``language_profiles`` (from ``language.fit_profiles``) adds language
    (F2); ``cluster_columns`` fills column_group by the 1-D 2-means of the
    document's blocks (F15) instead of the constant 0 the reference writes."""
    from . import toc as toc_ops

    raw = raw_blocks(folds.key_pages(spans))
    if cluster_columns:
        from .columns import column_groups
        raw = column_groups(raw)
    else:
        raw = raw.withColumn("column_group", F.lit(0))
    payload = RAW_PAYLOAD + ["by0", "column_group"]
    # the merged blocks lie by page as they are; the statistics come to the pages, so that no wide row moves
    per_doc = span_doc_stats(spans)
    if toc_lines is not None:
        per_doc = per_doc.join(toc_ops.entries_by_doc(toc_ops.toc_entries(toc_lines)), "doc_id", "left")
    merged = folds.by_page(folds.merge_runs(raw, payload), per_doc, spans, "left")
    merged = folds.restore_pages(merged, spans)
    feats = block_features(merged)
    out = merged.select("*", *[v.alias(k) for k, v in feats.items()]).select(
        "*",
        (F.col("avg_font_size") - F.col("median_font_size")).alias("font_size_diff"),
        (F.col("font_name") != F.col("dominant_font")).alias("font_diff_from_body"),
    )
    if language_profiles is not None:
        out = add_language(out.withColumn("text_for_lang", F.col("anchor_text")), language_profiles)
    else:
        out = out.withColumn("language", F.lit(None).cast("string"))
    if toc_lines is not None:
        out = toc_ops.flag_beside_entries(out)
    else:
        out = out.withColumn("in_TOC_flag", F.lit(False))
    return out.select("doc_id", "block_seq", "y0", *schemas.BLOCK_COLUMNS, *keep)


def add_language(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """F2 on the block (anchor) text; replaces ``language``. Best run on a
    materialized block table (see ``Corpus``)."""
    from . import language as lang_ops

    text = next(c for c in ("text_for_lang", "anchor_text", "text") if c in blocks.columns)
    langs = lang_ops.detect_language(blocks.select("doc_id", "page", "block_seq", F.col(text).alias("text")),
                                     profiles, ["doc_id", "page", "block_seq"])
    return blocks.drop("language").join(langs, ["doc_id", "page", "block_seq"], "left").drop("text_for_lang")


def number_blocks(blocks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dense position of each block in its document (0-based), without
    a window over a whole document: row_number inside the page plus the
    running count of earlier pages (``scan.running``, in bounded chunks)."""
    order = order or ["y0", "block_seq"]
    w = Window.partitionBy("doc_id", "page").orderBy(*order)
    within = blocks.withColumn("pos_in_page", F.row_number().over(w) - 1)
    per_page = blocks.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_page"))
    offsets = running(per_page, ["doc_id"], "page", "n_page", "page_offset")
    return within.join(offsets.select("doc_id", "page", "page_offset"), ["doc_id", "page"]).withColumn(
        "block_no", (F.col("page_offset") + F.col("pos_in_page")).cast("int")
    ).drop("page_offset", "pos_in_page")
