"""Counts of a text taken in one pass of array operations over a batch.

Counting by regular expressions costs an object per match, which was most of
the work of the block stage. Here the code points of a batch are looked up in a
table of character classes, and runs are counted by comparing neighbours. The
table covers code points below ``LIMIT``, where lower case is one character for
one; ``known`` is false for a text with any other one, and the caller counts
such a text by its regular expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"
LIMIT = 0x180
#: Characters that the arrays of one step hold; a longer text is a step of its own.
STEP = 1 << 19
WORD, VOWEL, UPPER, LETTER, END, ODD = 1, 2, 4, 8, 16, 32
FIELDS = ("n_words", "n_upper", "n_letters", "n_sentences", "n_vowel_runs", "n_no_vowel", "n_poly")


def _class(code: int) -> int:
    c = chr(code)
    kind = unicodedata.category(c)
    if len(c.lower()) != 1:
        return ODD
    blank = c in "\t\n\x0b\f\r " or kind.startswith("Z")
    return ((0 if blank else WORD) | (VOWEL if c.lower() in VOWELS else 0) | (UPPER if kind == "Lu" else 0)
            | (LETTER if kind.startswith("L") else 0) | (END if c in ".!?" else 0))


_TABLE = np.array([_class(i) for i in range(LIMIT)] + [ODD], dtype=np.uint8)
_BYTES = _TABLE[:256].tobytes()


def _classes(text: str) -> np.ndarray:
    """The class of each character; texts below U+0100 are looked up by byte."""
    try:
        return np.frombuffer(text.encode("latin-1").translate(_BYTES), dtype=np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return _TABLE[np.minimum(codes, LIMIT)]


def _steps(texts: list[str]) -> Iterator[list[str]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t) + 1
    yield texts[begin:]


def count_step(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of some texts; each is followed by a line break, so that no run crosses texts."""
    cls = _classes("\n".join(texts) + "\n")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    starts = ends - np.diff(ends, prepend=0)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int32)

    def begins(bit: int) -> np.ndarray:
        is_in = (cls & bit) != 0
        out = is_in.copy()
        out[1:] &= ~is_in[:-1]
        return out

    words, runs = begins(WORD), begins(VOWEL)
    n_words = per_text(words)
    at = np.flatnonzero(words)
    in_word = np.add.reduceat(runs, at, dtype=np.int32) if len(at) else np.zeros(0, np.int32)
    last = np.cumsum(n_words)

    def of_words(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[last] - total[last - n_words]).astype(np.int32)

    return {"known": per_text((cls & ODD) != 0) == 0, "n_words": n_words, "n_upper": per_text((cls & UPPER) != 0),
            "n_letters": per_text((cls & LETTER) != 0), "n_sentences": per_text(begins(END)), "n_vowel_runs": per_text(runs),
            "n_no_vowel": of_words(in_word == 0), "n_poly": of_words(in_word >= 3)}


@pandas_udf(T.StructType([T.StructField("known", T.BooleanType()), *[T.StructField(f, T.IntegerType()) for f in FIELDS]]))
def _counts(texts: pd.Series) -> pd.DataFrame:
    there = texts.notna().to_numpy()
    values = texts.where(there, "").tolist()
    parts = [count_step(step) for step in _steps(values)] if values else [count_step([""])]
    out = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})[:len(values)]
    out["known"] &= there
    return out


def text_counts(text: Column) -> Column:
    """Struct of ``known`` and FIELDS; the counts hold where ``known`` is true."""
    return _counts(F.when(F.is_valid_utf8(text), text))


def counted(counts: Column, field: str, otherwise: Column) -> Column:
    """A count, or ``otherwise`` (by regular expressions) where it is not known."""
    return F.when(counts["known"], counts[field]).otherwise(otherwise)
