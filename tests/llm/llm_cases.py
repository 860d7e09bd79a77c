"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, "the QUICK brown fox  jumps over the lazy dog again and again.", "en", "b"),
    (3, "Another text under this number.", "en", "b"),
    (3, "And one more text under the same number, which is longer.", None, None),
    (4, None, "en", "a"),
    (5, "", "de", "a"),
    (6, " \t\n ", "de", None),
    (7, "1234 5678 -- !!", "de", "a"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", None, "c"),
    (None, "A row without a number.", "en", "a"),
    (None, None, None, None),
    (10, "a " * 4000, "en", "c"),
    (11, "ü" * 5000 + " 日本語のテキスト mixed \x00 text", "de", "c"),
    (12, "solo", "en", "a"),
]
CLASH = ("dk", "rid", "row", "at", "key", "n", "size", "kept", "sig", "position", "copy", "spans", "place", "component_id", "_lang", "words")


def edge_docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def copies_fixture(spark, n=60, seed=5):
    """Short texts that share phrases; (doc_id, text) rows and a DataFrame."""
    rng = random.Random(seed)
    phrases = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(6, 40))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = (" " if i % 3 else "\n ").join(rng.choice(phrases) for _ in range(rng.randrange(0, 5)))
        rows.append((i * 3 % n if n % 3 else i, text))
    rows += [(n + i, "common words and then " + rows[0][1] + f" end{i}") for i in range(30)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")
