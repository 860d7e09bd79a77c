"""SRC3, F3, J3: table-of-contents lines, entries and the fuzzy TOC flag."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType

from ..functions.text import strip

# Fixed values (reference defaults).
TOC_MAX_PAGES = 3
TOC_SIMILARITY = 0.85
TOC_LINE_PATTERN = r"^(.+?)[\s\p{Z}]+\.{2,}[\s\p{Z}]+(\p{Nd}+)$"


def page_lines(spans: DataFrame, max_pages: int = TOC_MAX_PAGES) -> DataFrame:
    """SRC3: plain text lines of the first ``max_pages`` pages (spans of a
    line concatenated in order)."""
    s = spans.filter(F.col("page") <= max_pages)
    return s.groupBy("doc_id", "page", "block_seq", "line_seq").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_seq", "text"))),
                                 lambda x: x["text"]), "").alias("line")
    ).select("doc_id", "page", (F.col("block_seq").cast("long") * 100000 + F.col("line_seq")).alias("line_no"), "line")


def toc_entry(line: Column) -> Column:
    """the title part of a dot-leader line, NULL when it is none."""
    s = strip(line)
    return F.when(s.rlike(TOC_LINE_PATTERN), strip(F.regexp_extract(s, TOC_LINE_PATTERN, 1)))


def toc_entries(lines: DataFrame, max_pages: int = TOC_MAX_PAGES) -> DataFrame:
    return (
        lines.filter(F.col("page") <= max_pages)
        .select("doc_id", "page", "line_no", toc_entry(F.col("line")).alias("entry"))
        .filter(F.col("entry").isNotNull())
    )


#: Entries whose places a batch keeps, and characters of one that is kept.
KEPT = 1 << 10


def common_subsequence(places: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of ``text`` and a string of n characters given
    by the bits of its places, a step of word arithmetic per character of ``text``."""
    full = (1 << n) - 1
    v = full
    for c in text:
        m = places.get(c, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def ratios(entries: Iterable[str], texts: Iterable[str], threshold: float) -> list[float]:
    """Ratcliff-Obershelp ratio of each pair with the text as the second sequence (the
    argument order of the standard library's close-match search); 0 where it cannot reach
    the threshold. The matched blocks of a pair are a common subsequence, so that the longest
    one bounds the ratio; it costs a small part of the ratio and stops nearly all misses."""
    import difflib

    out = []
    sm = difflib.SequenceMatcher()
    known: dict[str, dict[str, int]] = {}
    for a, b in zip(entries, texts, strict=True):
        if a == b:
            out.append(1.0)
            continue
        places = known.get(a)
        if places is None:
            places = {}
            for i, c in enumerate(a):
                places[c] = places.get(c, 0) | 1 << i
            if len(known) >= KEPT:
                known.clear()
            if len(a) <= KEPT:
                known[a] = places
        if 2.0 * common_subsequence(places, len(a), b) / (len(a) + len(b)) < threshold:
            out.append(0.0)
            continue
        sm.set_seqs(a, b)
        out.append(sm.ratio())
    return out


@pandas_udf(DoubleType())
def sequence_ratio(entry: pd.Series, text: pd.Series, threshold: pd.Series) -> pd.Series:
    """``ratios`` of a batch; all rows have one threshold."""
    return pd.Series(ratios(entry, text, float(threshold.iloc[0])) if len(entry) else [], dtype="float64")


#: Letters counted apart for the multiset bound; all other characters are one class.
COUNTED = "etaonis "
#: Blocks of a document whose numbers share this many are one salt of the join.
SALT_BLOCKS = 1 << 14


def _length_band(n: Column, step: float) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(step)).cast("int")


def _class_counts(text: Column, prefix: str) -> list[Column]:
    """Characters of each class of COUNTED, and of none, as columns."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED]
    rest = F.length(text)
    for n in each:
        rest = rest - n
    return [c.alias(f"{prefix}{i}") for i, c in enumerate([*each, rest])]


def _common(text: Column, prefix: str) -> Column:
    """Characters in common by class with those counted in the columns of ``prefix``; each class
    of ``text`` is counted once, the rest being what is left of its length."""
    n, rest, out = len(COUNTED), F.length(text), F.lit(0)
    left = F.length(F.translate(text, COUNTED, ""))
    for i, c in enumerate(COUNTED):
        out = out + F.least(F.col(f"{prefix}{i}"), rest - F.length(F.replace(text, F.lit(c), F.lit(""))))
    return out + F.least(F.col(f"{prefix}{n}"), left)


def toc_candidates(blocks: DataFrame, entries: DataFrame, threshold: float = TOC_SIMILARITY) -> DataFrame:
    """J3 filter: (doc_id, page, block_seq, btext, entry) of every pair that can
    reach the threshold, and few others; no match is lost.

    A ratio r of texts of la and lb characters has r * (la + lb) / 2 of them
    matched. So (1) the lengths lie within a factor (2 - r) / r: they are cut
    into geometric bands of it and the join is an equi-join on (doc_id, band),
    the entry side copied to its neighbour bands; (2) the characters in common,
    counted by class, are at least as many. Both are JVM expressions on columns
    that each side computes once. (The edit distance is a closer bound, but
    costs more than the comparison that it saves.)

    The blocks of a long document are salted by their number, the entries
    (of its first pages) copied to its salts."""
    ratio_max = (2 - threshold) / threshold
    step = ratio_max * 1.0001
    num, den = int(round(threshold * 10000)), 10000
    salt = F.floor(F.col("block_seq") / F.lit(SALT_BLOCKS)).cast("int")
    b = blocks.select("doc_id", "page", "block_seq", strip(F.col("text")).alias("btext"), salt.alias("salt"))
    b = b.select("*", F.length("btext").alias("lb"), *_class_counts(F.col("btext"), "b"))
    b = b.withColumn("band", _length_band(F.col("lb"), step))
    e = entries.select("doc_id", "entry").dropDuplicates(["doc_id", "entry"])
    salts = blocks.groupBy("doc_id").agg(F.max(salt).alias("salts"))
    e = e.join(salts, "doc_id").withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))).drop("salts")
    e = e.select("*", F.length("entry").alias("la"), *_class_counts(F.col("entry"), "e"))
    e = e.withColumn("band", F.explode(F.array(*[_length_band(F.col("la"), step) + k for k in (-1, 0, 1)])))
    common = F.lit(0)
    for i in range(len(COUNTED) + 1):
        common = common + F.least(f"b{i}", f"e{i}")
    total = F.col("la") + F.col("lb")
    pairs = b.join(e, ["doc_id", "band", "salt"]).filter(common * 2 * den >= total * num)
    return pairs.select("doc_id", "page", "block_seq", "btext", "entry")


def toc_matches(blocks: DataFrame, entries: DataFrame, threshold: float = TOC_SIMILARITY) -> DataFrame:
    """J3 verify: (doc_id, page, block_seq, best_ratio) of the candidate pairs; a best ratio
    that cannot reach the threshold is 0."""
    pairs = toc_candidates(blocks, entries, threshold)
    scored = pairs.withColumn("ratio", sequence_ratio(F.col("entry"), F.col("btext"), F.lit(threshold)))
    return scored.groupBy("doc_id", "page", "block_seq").agg(F.max("ratio").alias("best_ratio"))


def add_toc_flags(blocks: DataFrame, toc_lines: DataFrame, threshold: float = TOC_SIMILARITY,
                  max_pages: int = TOC_MAX_PAGES) -> DataFrame:
    """in_TOC_flag = some TOC entry of the document matches the
    block text with ratio >= threshold; blocks without a candidate are
    false (left join)."""
    matches = toc_matches(blocks, toc_entries(toc_lines, max_pages), threshold)
    flags = matches.select("doc_id", "page", "block_seq",
                           (F.col("best_ratio") >= threshold).alias("in_TOC_flag"))
    base = blocks.drop("in_TOC_flag")
    return base.join(flags, ["doc_id", "page", "block_seq"], "left").withColumn(
        "in_TOC_flag", F.coalesce(F.col("in_TOC_flag"), F.lit(False)))


def entries_by_doc(entries: DataFrame) -> DataFrame:
    """(doc_id, toc_entries): the distinct entries of each document, lines of its first pages."""
    return entries.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("entry").alias("toc_entries"))


@pandas_udf(BooleanType())
def any_match(entries: pd.Series, text: pd.Series, threshold: pd.Series) -> pd.Series:
    """Whether some entry of a row's array has a ratio of at least the threshold with its text."""
    at = [i for i, es in enumerate(entries) for _ in (es if es is not None else ())]
    flat = [e for es in entries if es is not None for e in es]
    least = float(threshold.iloc[0]) if len(entries) else 0.0
    hits = {i for i, r in zip(at, ratios(flat, [text.iat[i] for i in at], least), strict=True) if r >= least}
    return pd.Series([i in hits for i in range(len(entries))], dtype="bool")


def flag_beside_entries(blocks: DataFrame, threshold: float = TOC_SIMILARITY) -> DataFrame:
    """J3 on blocks that have ``toc_entries`` (``entries_by_doc``) of their document beside them:
    in_TOC_flag as ``add_toc_flags`` gives it, without a join, so that no text moves. Of the
    entries those are compared that pass the bound of ``toc_candidates``; the lengths, which
    the bound implies, are looked at first. Blocks without a page or number are false."""
    num, den = int(round(threshold * 10000)), 10000
    b = blocks.withColumn("_btext", strip(F.col("text")))
    b = b.select("*", F.length("_btext").alias("_lb"), *_class_counts(F.col("_btext"), "_b"))

    def near(e: Column) -> Column:
        least = (F.length(e) + F.col("_lb")) * num
        return (F.least(F.length(e), F.col("_lb")) * 2 * den >= least) & (_common(e, "_b") * 2 * den >= least)

    keyed = F.col("page").isNotNull() & F.col("block_seq").isNotNull()
    b = b.withColumn("_found", F.when(keyed, F.filter("toc_entries", near)))
    some = F.size("_found") > 0
    b = b.withColumn("in_TOC_flag", any_match(F.when(some, F.col("_found")), F.when(some, F.col("_btext")), F.lit(threshold)))
    return b.drop("toc_entries", "_btext", "_lb", "_found", *[f"_b{i}" for i in range(len(COUNTED) + 1)])
