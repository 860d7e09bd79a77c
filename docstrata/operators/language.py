"""language of a text by character 3-gram profiles, as Spark jobs.

Fit: count 3-grams of every labelled document per language (partial
aggregation keeps the shuffle at one row per (language, gram) per task).
Score: explode a text's grams, join with the profile, sum log
probabilities per language, take the best. Texts without any letter are
"unknown". Whole texts are used, no prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
UNKNOWN = "unknown"
#: Languages whose gains are columns of one row of the joined profile.
WIDE = 32


def normalize(text: Column) -> Column:
    """Lower-case letters, every other run of characters one blank, padded."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))


def grams(text: Column) -> Column:
    """Overlapping character 3-grams in one linear regex pass (a
    look-ahead group matches at every position)."""
    return F.regexp_extract_all(normalize(text), F.lit(f"(?=(.{{{GRAM}}}))"), 1)


def gram_counts(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    g = df.select(*key, F.explode(grams(F.col(text_col))).alias("gram"))
    g = g.filter(F.col("gram") != "   ")
    return g.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def fit_profiles(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Profile rows (lang, gram, logp, dflt): add-one smoothed log
    probability of a gram in a language and the log probability of an
    unseen gram. The result is a model table: write it once
    (``plans.pipeline.write_stage``) before scoring, which reads it twice
    (defaults, join)."""
    from ..sources.tables import spread

    docs = spread(documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    counts = gram_counts(docs, ["lang"])
    # Add-one smoothing over the language's own gram vocabulary.
    tv = counts.groupBy("lang").agg(
        (F.sum("cnt") + F.count(F.lit(1))).cast("double").alias("den"))
    return counts.join(tv, "lang").select(
        "lang", "gram",
        F.log((F.col("cnt") + 1).cast("double") / F.col("den")).alias("logp"),
        F.log(1.0 / F.col("den")).alias("dflt"),
    )


def detect_language(texts: DataFrame, profiles: DataFrame, key: list[str]) -> DataFrame:
    """(key..., language) for every row of ``texts`` (key..., text).

    ``texts`` should be a materialized table (it is read twice: grams, and
    the gram count per text, which is length(normalized) - 2)."""
    defaults = profiles.select("lang", "dflt").distinct()
    # Bounded by the number of languages: read on the driver to pick the
    # language that wins when no gram of the text is in any profile.
    best_default = defaults.orderBy(F.desc("dflt"), "lang").limit(1).collect()
    if not best_default:
        return texts.select(*key, F.lit(UNKNOWN).alias("language"))
    fb_lang, fb_dflt = best_default[0]["lang"], float(best_default[0]["dflt"])
    names = [r["lang"] for r in defaults.filter("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]
    # The score is a sum over the text's grams: grams meet the profile as they
    # are, and a map-side sum leaves one row per text to shuffle where the
    # profile is small enough to be sent to the tasks. A row of the profile has the
    # gains of a gram in up to WIDE languages, so that a gram is one row, not one each.
    hits = texts.select(*key, F.explode(grams(F.col("text"))).alias("gram")).filter(F.col("gram") != " " * GRAM)
    matched: DataFrame | None = None
    for at in range(0, len(names), WIDE):
        some = list(enumerate(names[at:at + WIDE]))
        wide = profiles.filter(F.col("lang").isin([n for _, n in some])).groupBy("gram").agg(
            *[F.sum(F.when(F.col("lang") == n, F.col("logp") - F.col("dflt"))).alias(f"_g{i}") for i, n in some])
        sums = hits.join(wide, "gram").groupBy(*key).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i, _ in some])
        gains = F.array(*[F.struct(F.lit(n).alias("lang"), F.col(f"_g{i}").alias("gain")) for i, n in some])
        part = sums.select(*key, F.inline(gains)).filter("gain IS NOT NULL")
        matched = part if matched is None else matched.unionByName(part)
    if matched is None:
        matched = hits.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("gain")).filter(F.lit(False))
    # Number of grams of a text = length of the normalized text - 2.
    sizes = texts.select(*key, F.greatest(F.length(normalize(F.col("text"))) - (GRAM - 1), F.lit(0)).alias("n"))
    scored = matched.join(defaults, "lang").join(sizes, key).select(
        *key, "lang", (F.col("n") * F.col("dflt") + F.col("gain")).alias("score"))
    fallback = sizes.filter(F.col("n") > 0).select(
        *key, F.lit(fb_lang).alias("lang"), (F.col("n") * F.lit(fb_dflt)).alias("score"))
    best = scored.unionByName(fallback).groupBy(*key).agg(
        F.max_by("lang", F.struct("score", F.col("lang"))).alias("language"))
    return sizes.join(best, key, "left").select(
        *key, F.when(F.col("n") > 0, F.coalesce("language", F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN)).alias("language"))
