"""Counts by arrays against the regular expressions that they stand for."""

from pyspark.sql import functions as F

from docstrata.functions import counts as C
from docstrata.functions import readability as R
from docstrata.functions import text as X

TEXTS = ["", " ", "a", " a  b ", "tab\tb", "Ünïcode Ärger œuvre", "\U0001d400\U0001d41a x", "rhythm shh", "a.b!c?? d...", "beautiful oiseau",
         "... !!", "İstanbul ǅ", "line\nb", "aeiou " * 50, "x​b", "catastrophe-oriented; naïveté", None, "a b\x1cc\x85d",
         *[chr(i) + "a" + chr(i) + " " + chr(i) for i in range(1, 0x260)]]


def _rows(spark):
    text = F.col("t")
    low = F.lower(text)
    old = {"n_words": X.word_count(text), "n_upper": X.upper_count(text), "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]", "")),
           "n_sentences": F.regexp_count(text, F.lit(R.SENTENCE_END)), "n_vowel_runs": F.regexp_count(low, F.lit(R.VOWEL_RUN)),
           "n_no_vowel": F.regexp_count(low, F.lit(R.NO_VOWEL_WORD)), "n_poly": F.regexp_count(low, F.lit(R.POLY_WORD))}
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    return df.select("t", C.text_counts(text).alias("k"), F.struct(*[v.alias(n) for n, v in old.items()]).alias("old")).collect()


def test_counts_agree_with_the_expressions(spark):
    rows = _rows(spark)
    known = [r for r in rows if r.k.known]
    assert len(known) > 380 and not any(r.k.known for r in rows if r.t is None or any(ord(c) >= C.LIMIT for c in r.t))
    for r in known:
        assert {f: r.k[f] for f in C.FIELDS} == r.old.asDict(), repr(r.t)


def test_long_texts_are_steps_of_their_own():
    texts = ["word " * C.STEP, "a b", "", "c" * C.STEP, "d"]
    steps = list(C._steps(texts))
    assert [t for s in steps for t in s] == texts and [len(s) for s in steps] == [1, 2, 1, 1]
    assert C.count_step(steps[0])["n_words"].tolist() == [C.STEP]
    assert C.count_step(["", "b"])["n_no_vowel"].tolist() == [0, 1]
