"""The 36 group features (column expressions on a group row
joined with its document statistics and font percentile)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_CHAR_PATTERN, count_char, word_count
from .structure import CHAPTER, NUMBERED

# Fixed values (reference feature order).
FEATURES = [
    "text_length", "word_count", "group_size", "page",
    "avg_font_size", "max_font_size", "font_std", "font_ratio_to_body", "font_percentile",
    "min_y_position", "avg_y_position",
    "bold_ratio", "italic_ratio", "center_ratio", "avg_caps_ratio", "avg_indentation",
    "avg_spacing", "max_spacing", "spacing_ratio",
    "is_grouped", "has_hyphen_split", "has_colon_split",
    "has_numbering", "has_chapter_pattern", "starts_with_capital",
    "sentence_count", "ends_with_period", "has_special_chars",
    "is_very_short", "is_short", "is_medium", "is_long",
    "is_top_of_page", "is_upper_half", "is_first_page", "is_early_page",
]


def feature_columns() -> dict[str, Column]:
    t = F.col("text")
    wc = word_count(t)
    y = F.col("min_y_position")
    return {
        "text_length": F.length(t).cast("long"),
        "word_count": wc.cast("long"),
        "group_size": F.col("group_size").cast("long"),
        "page": F.col("page").cast("long"),
        "avg_font_size": F.col("avg_font_size"),
        "max_font_size": F.col("max_font_size"),
        "font_std": F.col("font_std"),
        "font_ratio_to_body": F.col("avg_font_size") / F.col("most_common_font"),
        "font_percentile": F.col("font_percentile"),
        "min_y_position": y,
        "avg_y_position": F.col("avg_y_position"),
        "bold_ratio": F.col("bold_ratio"),
        "italic_ratio": F.col("italic_ratio"),
        "center_ratio": F.col("center_ratio"),
        "avg_caps_ratio": F.col("avg_caps_ratio"),
        "avg_indentation": F.col("avg_indentation"),
        "avg_spacing": F.col("avg_spacing"),
        "max_spacing": F.col("max_spacing"),
        "spacing_ratio": F.col("avg_spacing") / F.greatest(F.col("doc_avg_spacing"), F.lit(1.0)),
        "is_grouped": F.col("group_size") > 1,
        "has_hyphen_split": F.col("has_hyphen_split"),
        "has_colon_split": F.col("has_colon_split"),
        "has_numbering": t.rlike(NUMBERED),
        "has_chapter_pattern": t.rlike(CHAPTER),
        "starts_with_capital": F.substring(t, 1, 1).rlike(r"^\p{Lu}"),
        "sentence_count": (count_char(t, ".") + count_char(t, "!") + count_char(t, "?")).cast("long"),
        "ends_with_period": t.endswith("."),
        "has_special_chars": t.rlike(SPECIAL_CHAR_PATTERN),
        "is_very_short": wc <= 3,
        "is_short": wc <= 10,
        "is_medium": (wc > 10) & (wc <= 30),
        "is_long": wc > 30,
        "is_top_of_page": y <= 0.1,
        "is_upper_half": y <= 0.5,
        "is_first_page": F.col("page") == 1,
        "is_early_page": F.col("page") <= 2,
    }


FEATURE_COLS = [f"f_{k}" for k in FEATURES]


def numeric_features() -> list[Column]:
    """Every feature as a double, NULL -> 0, in the fixed order
    (columns ``f_<name>``)."""
    fc = feature_columns()
    return [F.coalesce(fc[k].cast("double"), F.lit(0.0)).alias(f"f_{k}") for k in FEATURES]
