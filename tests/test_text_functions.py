"""Scalar text rules against plain Python on hand-written edge rows."""

import re

from pyspark.sql import functions as F

from docstrata.functions import text as X
from docstrata.functions.readability import readability


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("r")).first()["r"]


def test_strip_unicode_space(spark):
    assert one(spark, X.strip, "  Title ") == "Title"
    assert one(spark, X.strip, " x y\t") == "x y"


def test_word_count_matches_split(spark):
    for s in ["", "   ", "a b  c", " one two ", "x\ty\nz"]:
        assert one(spark, X.word_count, s) == len(s.split()), s


def test_caps_ratio_counts_trailing_space(spark):
    s = "ABc "
    assert abs(one(spark, X.caps_ratio, s) - 2 / 4) < 1e-12


# Fixed value: the numbering pattern of the given rule set.
def test_numbering_pattern(spark):
    pat = re.compile(r"^(\d+[\.\)]|[A-Z][\.\)]|\(?[ivx]+\)?)[\s\-:]", re.IGNORECASE)
    for s in ["1. Intro", "A) point", "(iv) x", "I am", "Intro", "12 Angry", "b.-x", "x"]:
        assert one(spark, X.starts_with_numbering, s) == bool(pat.match(s)), s


def test_bullets(spark):
    for s, exp in [("• item", True), ("- item", True), ("– dash", True), ("item", False), ("○ x", True)]:
        assert one(spark, X.starts_with_bullet, s) is exp


def test_title_case_rule(spark):
    cases = {
        "The Lord of the Rings": True,
        "The Lord Of the Rings": False,
        "the Lord": False,
        "War and Peace": True,
        "A Tale of": False,
        "1984 Is Here": True,
        "Hello world": False,
        "HELLO WORLD": True,
        "Über Alles": True,
        "": True,
    }
    for s, exp in cases.items():
        assert one(spark, X.is_title_case, s) is exp, s


def test_special_chars_are_unicode_aware(spark):
    df = spark.createDataFrame([("élan vital",), ("a # b",), ("naïve, ok!",)], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(X.SPECIAL_CHAR_PATTERN)).collect()]
    assert got == [False, True, False]


def test_readability_counts(spark):
    df = spark.createDataFrame([("The cat sat. The dog ran. It is fine.",)], "t string")
    r = df.select(*[v.alias(k) for k, v in readability(F.col("t")).items()]).first()
    words, sents, syl = 9, 3, 10  # "fine" has two vowel runs
    assert abs(r["flesch_reading_ease"] - (206.835 - 1.015 * words / sents - 84.6 * syl / words)) < 1e-9
    assert r["smog_index"] > 0


def test_collapse_ws(spark):
    assert one(spark, X.collapse_ws, "  a \n\n b\t c ") == "a b c"


def test_strip_is_its_pattern(spark):
    from docstrata.functions.text import STRIP_PATTERN, WS_CHARS, strip

    texts = [None, "", " ", *[w + "a" + w + "b" + w for w in WS_CHARS], WS_CHARS, "a \x85", " \x85", "a\x85 ", "​a﻿"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", STRIP_PATTERN, ""))).count() == 0
    assert df.where(strip(F.col("t")).contains("a b")).count() == 1
