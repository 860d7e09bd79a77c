"""Portable text column functions.

Python's ``str.strip`` / ``split`` / ``\\w`` are Unicode-aware, Java and RE2
regex classes are ASCII by default, so every class is written out with
Unicode properties. The same patterns run in DuckDB (RE2) for the oracle.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.isspace() sees it (close enough: \s plus Z*).
WS = r"[\s\p{Z}]"
NOT_BLANK = r"[^\s\p{Z}]"
# Every white space but the blank, and some characters that are none.
ODD_SPACE = "[\\t\\n\\x0b\\f\\r\\xa0\\u1680\\u2000-\\u3000]"
STRIP_PATTERN = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

# Fixed values (reference rule set).
# Numbered-line test, case-insensitive: digits + '.' or ')', a letter + '.'
# or ')', or a roman numeral of i/v/x in optional brackets; then space,
# '-' or ':'.
NUMBERING_PATTERN = r"(?i)^(\p{Nd}+[.)]|[A-Z][.)]|\(?[ivx]+\)?)[\s\p{Z}\-:]"
# Bullet characters: U+2022 U+2023 U+25E6 U+2219 U+00B7 U+2043 U+2013
# U+25AA U+25AB U+25A0 U+25A1 U+27A4 U+2794 U+2726 U+2727 '-' '+' U+25CF U+25CB
BULLETS = [
    "•", "‣", "◦", "∙", "·", "⁃", "–",
    "▪", "▫", "■", "□", "➤", "➔", "✦",
    "✧", "-", "+", "●", "○",
]
# Small words kept lower-case inside a title-cased text (public list of
# the title-case convention).
TITLE_SMALL_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "of",
    "on", "or", "the", "to", "v", "v.", "via", "vs", "vs.",
]
# Characters that do not count as "special" in a group text: word
# characters, white space and . , - : ; ! ?
SPECIAL_CHAR_PATTERN = r"[^\p{L}\p{N}_\s\p{Z}.,\-:;!?]"


# The characters of WS.
WS_CHARS = "".join(chr(i) for i in range(0x10000) if chr(i) in "\t\n\x0b\f\r" or unicodedata.category(chr(i))[0] == "Z")


def strip(c: Column) -> Column:
    """STRIP_PATTERN taken off; only the ends are looked at, where the expression tries
    every blank. U+0085 is no blank, but ``$`` also holds before one at the end."""
    return F.when(c.contains("\x85"), F.regexp_replace(c, STRIP_PATTERN, "")).otherwise(F.trim(c, F.lit(WS_CHARS)))


def words(c: Column) -> Column:
    """``text.split()``: non-empty pieces between white-space runs."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    """Number of maximal non-white-space runs (= ``len(text.split())``).

    Where single blanks between words are the only white space, their count
    and one; the expression costs a string for each word."""
    plain = ~c.rlike(ODD_SPACE) & ~c.contains("  ") & ~c.startswith(" ") & ~c.endswith(" ") & (c != "")
    return F.when(plain, count_char(c, " ") + 1).otherwise(F.regexp_count(c, F.lit(r"[^\s\p{Z}]+")))


def caps_ratio(c: Column) -> Column:
    """Upper-case characters over max(length, 1), on the text as given."""
    return upper_count(c) / F.greatest(F.length(c), F.lit(1))


def upper_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]+", ""))


def starts_with_numbering(stripped: Column) -> Column:
    return stripped.rlike(NUMBERING_PATTERN)


def starts_with_bullet(stripped: Column) -> Column:
    return F.substring(stripped, 1, 1).isin(BULLETS)


def _title_case_violation() -> str:
    """One regex that finds a word breaking the title-case rule.

    A word's core is the word without leading non-letter/digit characters.
    The first and the last word break the rule when their core starts
    with a lower-case letter; a middle word breaks it when its core is
    not exactly one of the small words and either starts lower-case or is
    a small word in another case ("Of")."""
    small = "|".join(w.replace(".", r"\.") for w in TITLE_SMALL_WORDS)
    ws, lead, low = r"[\s\p{Z}]", r"[^\p{L}\p{N}\s\p{Z}]*", r"[\p{Ll}\p{Lt}]"
    first = rf"^{lead}{low}"
    last = rf"{ws}{lead}{low}[^\s\p{{Z}}]*$"
    exact_small = rf"(?!(?:{small}){ws})"
    middle_low = rf"{ws}{lead}{exact_small}{low}[^\s\p{{Z}}]*(?={ws})"
    middle_small = rf"{ws}{lead}{exact_small}(?i:{small})(?={ws})"
    return "|".join(f"(?:{p})" for p in (first, last, middle_low, middle_small))


TITLE_CASE_VIOLATION = _title_case_violation()


def is_title_case(stripped: Column) -> Column:
    """Every word starts upper-case, except small words that are neither
    first nor last, which must be lower-case. Words whose core starts
    with no letter are ignored. Input: the stripped text."""
    return ~stripped.rlike(TITLE_CASE_VIOLATION)


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def collapse_ws(c: Column) -> Column:
    """white-space runs to one blank, then trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))
