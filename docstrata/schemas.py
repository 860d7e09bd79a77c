"""Fixed table schemas (D1-D6 of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per text span, block bbox repeated on each span.
SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("block_seq", T.IntegerType()),
    T.StructField("line_seq", T.IntegerType()),
    T.StructField("span_seq", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("font", T.StringType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("color", T.IntegerType()),
    T.StructField("bx0", T.DoubleType()),
    T.StructField("by0", T.DoubleType()),
    T.StructField("bx1", T.DoubleType()),
    T.StructField("by1", T.DoubleType()),
    T.StructField("page_width", T.DoubleType()),
    T.StructField("page_height", T.DoubleType()),
])

# Style flags kept per block (any-of over spans); order is the block record's.
STYLE_COLUMNS = [
    "is_bold", "is_italic", "is_serif", "is_sans_serif", "is_monospace",
    "is_script", "is_symbol", "is_display", "is_light", "is_black",
    "is_condensed", "is_expanded",
]

# The block record written per document (plus engine keys doc_id,
# block_seq and the sort key y0).
BLOCK_COLUMNS = [
    "page", "text", "language", "avg_font_size", "font_size_diff",
    "font_diff_from_body", "font_name", *STYLE_COLUMNS,
    "text_color_r", "text_color_g", "text_color_b", "is_black_text",
    "is_underlined", "indentation_ratio", "is_strikethrough", "is_header",
    "is_footer", "flesch_reading_ease", "smog_index", "coleman_liau",
    "caps_ratio", "is_title_case", "is_short", "starts_with_numbering",
    "is_center_aligned", "y_position_relative", "spacing_above",
    "is_bullet_point", "column_group", "in_TOC_flag",
]

# Columns the structure stage reads from a block record.
STRUCTURE_INPUT = [
    "doc_id", "page", "block_seq", "y0", "text", "avg_font_size", "font_name",
    "is_bold", "is_italic", "is_center_aligned", "caps_ratio",
    "indentation_ratio", "y_position_relative", "spacing_above",
]

# Outline of one document.
OUTLINE_ENTRY = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

# One request file.
REQUEST = T.StructType([
    T.StructField("challenge_info", T.StructType([
        T.StructField("challenge_id", T.StringType()),
        T.StructField("test_case_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ])),
    T.StructField("documents", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("title", T.StringType()),
    ]))),
    T.StructField("persona", T.StructType([T.StructField("role", T.StringType())])),
    T.StructField("job_to_be_done", T.StructType([T.StructField("task", T.StringType())])),
])

# D6 pieces.
SECTION = T.StructType([
    T.StructField("section_title", T.StringType()),
    T.StructField("importance_rank", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("document", T.StringType()),
])
SUBSECTION = T.StructType([
    T.StructField("document", T.StringType()),
    T.StructField("refined_text", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
])

# Model answer parsed by F5 (one element of the JSON array).
# Numbers are read as text first: models quote them.
MODEL_SECTION = "section_title string, importance_rank string, page_number string"
