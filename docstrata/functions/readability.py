"""F1: readability scores as column formulas.

Published formulas (Flesch reading ease, SMOG, Coleman-Liau) over counts
taken with regular expressions: words are white-space tokens, sentences
are runs of ``.!?`` (at least one), syllables are vowel runs per word (at
least one), letters are Unicode letters. No syllable dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .counts import VOWELS, counted, text_counts
from .text import word_count

VOWEL_RUN = rf"[{VOWELS}]+"
SENTENCE_END = r"[.!?]+"
# A whole word (white-space token) without any vowel: one syllable.
NO_VOWEL_WORD = rf"(?<![^\s\p{{Z}}])[^\s\p{{Z}}{VOWELS}]+(?![^\s\p{{Z}}])"
# A whole word with at least three vowel runs (possessive, so one run is
# never split into several).
POLY_WORD = rf"(?<![^\s\p{{Z}}])(?:[^\s\p{{Z}}{VOWELS}]*+[{VOWELS}]++){{3}}[^\s\p{{Z}}]*"


def readability(text: Column, counts: Column | None = None) -> dict[str, Column]:
    """Counts of the whole text (``text_counts``; by regular expressions where it
    does not know a character): syllables = vowel runs + words without a vowel
    (each word counts at least one); vowel runs never cross a word since blanks
    are no vowels."""
    counts = text_counts(text) if counts is None else counts
    low = F.lower(text)
    n_words = F.greatest(counted(counts, "n_words", word_count(text)), F.lit(1)).cast("double")
    n_sent = F.greatest(counted(counts, "n_sentences", F.regexp_count(text, F.lit(SENTENCE_END))), F.lit(1)).cast("double")
    n_syl = (counted(counts, "n_vowel_runs", F.regexp_count(low, F.lit(VOWEL_RUN)))
             + counted(counts, "n_no_vowel", F.regexp_count(low, F.lit(NO_VOWEL_WORD)))).cast("double")
    n_poly = counted(counts, "n_poly", F.regexp_count(low, F.lit(POLY_WORD))).cast("double")
    n_letters = counted(counts, "n_letters", F.length(F.regexp_replace(text, r"[^\p{L}]", ""))).cast("double")
    flesch = F.lit(206.835) - F.lit(1.015) * (n_words / n_sent) - F.lit(84.6) * (n_syl / n_words)
    smog = F.when(n_sent >= 3, F.lit(1.043) * F.sqrt(n_poly * 30 / n_sent) + F.lit(3.1291)).otherwise(F.lit(0.0))
    cli = F.lit(0.0588) * (n_letters / n_words * 100) - F.lit(0.296) * (n_sent / n_words * 100) - F.lit(15.8)
    return {"flesch_reading_ease": flesch, "smog_index": smog, "coleman_liau": cli}
