"""Stage 2: blocks -> groups -> document statistics -> title + outline.

Plan (one shuffle of the blocks by (doc_id, page), reused by the pair-test
lag, the cap fold and the group aggregation):

    blocks -> lag pair test -> run id -> fold in run -> groupBy group (A7)
    blocks -> partial aggregates by doc_id (A4-A6) -> doc_stats (1 row/doc)
    groups x doc_stats (J4, by page) -> scores (F9) -> min_by per doc (A8) -> titles
    groups x titles (J6) -> heading level (F10) -> outline rows (ML9, A14)

Per-document results are partial aggregates (``min_by``, ``percentile``
with its value->count buffer, counts, sums), so a document holding a third
of all rows never has to be collected into one task; joins on doc_id have
one row per document on the statistics side (AQE turns them into
broadcasts when the measured size is small, and splits skewed
partitions otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_CHAR_PATTERN, count_char, strip, word_count
from . import folds
from .scan import cumulative, percentiles_of

# Fixed values (reference rule set).
TITLE_MIN_CHARS = 3
TITLE_CUTOFF_PREDICT = 5.0
TITLE_CUTOFF_LABEL = 6.0
RULE_CONFIDENCE = 0.7
HEADING_MAX_CHARS = 200
HEADING_MAX_WORDS = 25
LEVELS = ["H1", "H2", "H3", "H4"]
NUMBERED = r"^\p{Nd}+\.?[\s\p{Z}]+"
SUB_NUMBERED = r"^\p{Nd}+\.\p{Nd}+\.?[\s\p{Z}]+"
ONLY_DIGITS = r"^\p{Nd}+[\s\p{Z}]*$"
CHAPTER = r"(?i)chapter|section|part"

ORDER = ["y0", "block_seq"]
#: Distinct block sizes of a document that its groups carry with them.
FEW_SIZES = 64


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """Stage-2 input (``stage_input``), rows of a page together."""
    return stage_input(blocks).repartition("doc_id", "page")


def stage_input(blocks: DataFrame) -> DataFrame:
    """The columns the structure stage reads, NULL-safe
    defaults where the reference reads with a default."""
    cols = blocks.columns
    def c(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)
    y0 = F.col("y0") if "y0" in cols else F.col("block_seq").cast("double")
    return blocks.select(
        "doc_id", "page", "block_seq", y0.alias("y0"), "text", "avg_font_size", "y_position_relative",
        c("font_name", "").alias("font_name"), c("is_bold", False).alias("is_bold"),
        c("is_italic", False).alias("is_italic"), c("is_center_aligned", False).alias("is_center_aligned"),
        c("caps_ratio", 0.0).alias("caps_ratio"), c("indentation_ratio", 0.0).alias("indentation_ratio"),
        c("spacing_above", 0.0).alias("spacing_above"),
    )


def round_tenth(x: Column) -> Column:
    """x >= 0 rounded to one decimal as its exact binary value lies, ties to even.

    The half between the tenths k and k + 1 is (2k + 1) / 20; its double is
    compared with x, and where they are the same double, twenty times it with
    2k + 1: its parts 16 and 4 times are exact, and so are both differences."""
    k = F.floor(x * 10).cast("double")
    odd = 2 * k + 1
    half = odd / 20
    error = half * 4 - (odd - half * 16)
    up = F.when(x != half, x > half).when(error != 0, error > 0).otherwise(k % 2 == 1)
    return F.when(up, (k + 1) / 10).otherwise(k / 10)


def size_counts(blocks: DataFrame) -> DataFrame:
    """The distinct block sizes of each document (null too), their counts and first places, written:
    the statistics read them."""
    from ..plans.pipeline import write_stage

    return write_stage(blocks.groupBy("doc_id", F.col("avg_font_size").alias("v")).agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("page", *ORDER)).alias("first")))


def _known(sizes: DataFrame) -> DataFrame:
    return sizes.filter(F.col("v").isNotNull()).select("doc_id", "v", "c")


def doc_stats(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Per-document statistics over all blocks.

    total_items, bold_ratio, center_ratio, avg_spacing (mean of positive
    spacings, 0 if none), font_p50/75/85/95 (linear interpolation),
    most_common_font (mode of sizes rounded to 1 place by their exact value;
    first seen wins). Percentiles are selected without a document's sizes in
    one buffer (``scan.percentiles``)."""
    base = blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.avg(F.col("is_bold").cast("double")).alias("bold_ratio"),
        F.avg(F.col("is_center_aligned").cast("double")).alias("center_ratio"),
        F.coalesce(F.avg(F.when(F.col("spacing_above") > 0, F.col("spacing_above"))), F.lit(0.0)).alias("avg_spacing"),
    )
    sizes = size_counts(blocks) if sizes is None else sizes
    pct = percentiles_of(_known(sizes), ["doc_id"], [0.5, 0.75, 0.85, 0.95]).select(
        "doc_id", *[F.col("pct")[i].alias(n) for i, n in enumerate(["font_p50", "font_p75", "font_p85", "font_p95"])])
    base = base.join(pct, "doc_id", "left")
    rounded = sizes.groupBy("doc_id", round_tenth(F.col("v")).alias("r")).agg(F.sum("c").alias("cnt"), F.min("first").alias("first"))
    body = rounded.groupBy("doc_id").agg(
        F.min_by("r", F.struct((-F.col("cnt")).alias("c"), "first")).alias("most_common_font"))
    return base.join(body, "doc_id")


def group_blocks(blocks: DataFrame) -> DataFrame:
    """W4 + A7: one row per group with its aggregates; ``first_y0`` /
    ``first_seq`` (the first block) give the group order in its page."""
    g = folds.group_runs(blocks)
    grp = g.groupBy("doc_id", "page", "run_id", "gid").agg(
        F.sort_array(F.collect_list(F.struct(*ORDER, strip(F.col("text")).alias("t"), F.col("y_position_relative").alias("y")))).alias("members"),
        F.avg("avg_font_size").alias("avg_font_size"),
        F.max("avg_font_size").alias("max_font_size"),
        F.coalesce(F.stddev_samp("avg_font_size"), F.lit(0.0)).alias("font_std"),
        F.min("y_position_relative").alias("min_y_position"),
        F.avg("y_position_relative").alias("avg_y_position"),
        F.avg(F.col("is_bold").cast("double")).alias("bold_ratio"),
        F.avg(F.col("is_italic").cast("double")).alias("italic_ratio"),
        F.avg(F.col("is_center_aligned").cast("double")).alias("center_ratio"),
        F.avg("spacing_above").alias("avg_spacing"),
        F.max("spacing_above").alias("max_spacing"),
        F.avg("caps_ratio").alias("avg_caps_ratio"),
        F.avg("indentation_ratio").alias("avg_indentation"),
        F.bool_or("is_bold").alias("any_bold"),
        F.bool_or("is_center_aligned").alias("any_center"),
        F.count(F.lit(1)).alias("group_size"),
    )
    n, first = F.size("members"), F.element_at("members", 1)
    head = F.slice("members", 1, n - 1)
    return grp.select(
        "doc_id", "page",
        first["y0"].alias("first_y0"), first["block_seq"].alias("first_seq"),
        strip(F.array_join(F.transform("members", lambda m: m["t"]), " ")).alias("text"),
        "avg_font_size", "max_font_size", "font_std", "min_y_position", "avg_y_position",
        first["y"].alias("first_y_position"), "bold_ratio", "italic_ratio", "center_ratio", "avg_spacing", "max_spacing",
        "avg_caps_ratio", "avg_indentation", "any_bold", "any_center", "group_size",
        F.exists(head, lambda m: m["t"].endswith("-")).alias("has_hyphen_split"),
        F.exists(head, lambda m: m["t"].endswith(":")).alias("has_colon_split"),
    )


def font_percentiles(blocks: DataFrame, groups: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Share of the document's block sizes <= each group's mean
    size. Both sides are first reduced to distinct values per document and
    counted up in ranges of values (``scan.cumulative``), so that no window
    runs over a document."""
    dist = _known(size_counts(blocks) if sizes is None else sizes)
    asked = groups.select("doc_id", F.col("avg_font_size").alias("v")).distinct().select("doc_id", "v", F.lit(0).cast("long").alias("c"), F.lit(True).alias("q"))
    both = dist.withColumn("q", F.lit(False)).unionByName(asked).groupBy("doc_id", "v").agg(F.sum("c").alias("c"), F.bool_or("q").alias("q"))
    le = cumulative(both, ["doc_id"], keep=["q"])
    return le.filter("q").select("doc_id", F.col("v").alias("avg_font_size"), (F.col("le") / F.col("n")).alias("font_percentile"))


def few_sizes(sizes: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, few): the counts of the block sizes of each document that has up to ``FEW_SIZES``, and
    whether some document has more."""
    dist = _known(sizes)
    n = dist.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    more = not n.filter(F.col("n") > FEW_SIZES).isEmpty()
    dist = dist.join(n.filter(F.col("n") <= FEW_SIZES).select("doc_id"), "doc_id", "left_semi") if more else dist
    return dist.groupBy("doc_id").agg(F.collect_list(F.struct("v", "c")).alias("few")), more


def share_of_few() -> Column:
    """J5 of a group from the counts (``few``) of its document's sizes."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["c"])

    size = F.col("avg_font_size")
    return F.when(size.isNotNull(), total(F.filter("few", lambda x: x["v"] <= size)) / total(F.col("few")))


def with_font_percentile(blocks: DataFrame, groups: DataFrame, sizes: DataFrame, more: bool) -> DataFrame:
    """J5 added to groups that carry ``few``: read from it, or for documents of more sizes joined
    from ``font_percentiles``."""
    from ..plans.pipeline import write_stage

    if not more:
        return groups.withColumn("font_percentile", share_of_few()).drop("few")
    groups = write_stage(groups)
    many = groups.filter(F.col("few").isNull()).drop("few")
    pct = font_percentiles(blocks, many, sizes)
    few = groups.filter(F.col("few").isNotNull()).withColumn("font_percentile", share_of_few()).drop("few")
    return few.unionByName(many.join(pct, ["doc_id", "avg_font_size"], "left"))


def _tiers(value: Column, tiers: list[tuple[float, float]], default: float = 0.0) -> Column:
    expr = None
    for bound, pts in tiers:
        expr = F.when(value >= bound, pts) if expr is None else expr.when(value >= bound, pts)
    return expr.otherwise(default)


# Points of the title penalties.
PENALTY_POINTS = {"only_digits": -6.0, "page_word": -5.0, "too_long": -5.0, "many_dots": -3.0}


def penalties(text: Column, words: Column | None = None) -> dict[str, Column]:
    """the conditions that take points from a title candidate. ``words``: its word count, if it is there."""
    words = word_count(text) if words is None else words
    return {
        "only_digits": strip(text).rlike(ONLY_DIGITS),
        "page_word": (words <= 3) & F.lower(text).contains("page"),
        "too_long": F.length(text) > 200,
        "many_dots": count_char(text, ".") > 3,
    }


def title_score(words: Column | None = None) -> Column:
    """F9 on a group row joined with its document statistics. All bounds
    and points below are fixed values. ``words``: the word count, if it is there."""
    text = F.col("text")
    wc = word_count(text) if words is None else words
    body = F.col("most_common_font")
    ratio = F.when(body > 0, F.col("avg_font_size") / body).otherwise(F.lit(1.0))
    mx = F.col("max_font_size")
    size_pts = F.when(mx >= F.col("font_p95"), 8.0).when(mx >= F.col("font_p85"), 6.0).when(
        mx >= F.col("font_p75"), 4.0).otherwise(0.0)
    ratio_pts = _tiers(ratio, [(2.0, 6.0), (1.5, 4.0), (1.3, 3.0), (1.1, 2.0)])
    page_pts = F.when(F.col("page") == 1, 5.0).when(F.col("page") == 2, 2.0).otherwise(0.0)
    y = F.col("min_y_position")
    y_pts = F.when(y <= 0.1, 6.0).when(y <= 0.2, 4.0).when(y <= 0.3, 2.0).otherwise(0.0)
    bold_pts = F.when(F.col("any_bold") & (F.col("doc_bold_ratio") < 0.3), 3.0).otherwise(0.0)
    center_pts = F.when(F.col("any_center") & (F.col("doc_center_ratio") < 0.2), 4.0).otherwise(0.0)
    wc_pts = F.when(wc.between(5, 12), 3.0).when(wc.between(2, 20), 2.0).when(wc > 30, -4.0).otherwise(0.0)
    caps = F.col("avg_caps_ratio")
    caps_pts = F.when(caps > 0.7, 2.0).when(caps > 0.3, 1.5).otherwise(0.0)
    spacing_pts = F.when(F.col("avg_spacing") > F.col("doc_avg_spacing") * 2, 2.0).otherwise(0.0)
    penalty = sum((F.when(hit, PENALTY_POINTS[k]).otherwise(0.0) for k, hit in penalties(text, wc).items()), F.lit(0.0))
    return (size_pts + ratio_pts + page_pts + y_pts + bold_pts + center_pts + wc_pts + caps_pts
            + spacing_pts + penalty)


def heading_level(is_title: Column | None = None, words: Column | None = None) -> Column:
    """F10 on a group row joined with its document statistics. ``words``: the word count, if it is there."""
    text = F.col("text")
    n = F.length(text)
    wc = word_count(text) if words is None else words
    ratio = F.col("avg_font_size") / F.col("most_common_font")
    score = (
        _tiers(ratio, [(1.5, 4.0), (1.3, 3.0), (1.1, 2.0)])
        + F.when(F.col("any_bold"), 2.0).otherwise(0.0)
        + F.when(F.col("avg_spacing") > F.col("doc_avg_spacing") * 1.5, 2.0).otherwise(0.0)
        + F.when((F.col("page") == 1) & (F.col("first_y_position") < 0.3), 1.0).otherwise(0.0)
        + F.when(wc.between(3, 10), 1.5).otherwise(0.0)
    )
    level = (
        F.when(n < 3, "body").when(n > HEADING_MAX_CHARS, "body").when(wc > HEADING_MAX_WORDS, "body")
        .when(text.rlike(NUMBERED), "H2").when(text.rlike(SUB_NUMBERED), "H3")
        .when(score >= 4.0, F.when(ratio >= 1.4, "H1").when(ratio >= 1.2, "H2").otherwise("H3"))
        .when(score >= 2.5, "H3").when(score >= 1.5, "H4").otherwise("body")
    )
    if is_title is not None:
        level = F.when(is_title, "body").otherwise(level)
    return level


STAT_RENAMES = {"bold_ratio": "doc_bold_ratio", "center_ratio": "doc_center_ratio",
                "avg_spacing": "doc_avg_spacing"}


def with_doc_stats(groups: DataFrame, stats: DataFrame) -> DataFrame:
    """Each group with its document's statistics."""
    return groups.join(renamed_stats(stats), "doc_id")


def renamed_stats(stats: DataFrame) -> DataFrame:
    """Statistics under names that a group's own columns do not have."""
    for a, b in STAT_RENAMES.items():
        stats = stats.withColumnRenamed(a, b)
    return stats


def title_candidates(scored: DataFrame) -> DataFrame:
    return scored.filter(F.length("text") >= TITLE_MIN_CHARS)


def best_titles(scored: DataFrame, cutoff: float = TITLE_CUTOFF_PREDICT) -> DataFrame:
    """Best candidate per document (score desc, then
    document order); title = its text when score > cutoff else ''."""
    cand = title_candidates(scored)
    order = F.struct((-F.col("score")).alias("s"), "page", "first_y0", "first_seq")
    best = cand.groupBy("doc_id").agg(F.min_by(F.struct("text", "score"), order).alias("b"))
    return best.select(
        "doc_id",
        F.when(F.col("b.score") > cutoff, F.col("b.text")).otherwise(F.lit("")).alias("title"),
        F.col("b.score").alias("title_score"),
        F.least(F.col("b.score") / 10.0, F.lit(1.0)).alias("title_confidence"),
    )


def structure(blocks: DataFrame) -> dict[str, DataFrame]:
    """Groups, statistics, scored groups and titles of every document.

    The statistics are taken from the blocks first; the groups meet them by page
    (``folds.by_page``), where they are made, and no group is shuffled."""
    source = stage_input(blocks)
    b = prepare_blocks(blocks)
    groups = group_blocks(b)
    sizes = size_counts(source)
    stats = doc_stats(source, sizes)
    few, more = few_sizes(sizes)
    keyed = group_blocks(folds.key_pages(source).repartition("doc_id", "page"))
    per_doc = renamed_stats(stats).join(few, "doc_id", "left")
    g = folds.restore_pages(folds.by_page(keyed, per_doc, source, "inner"), source)
    g = with_font_percentile(source, g, sizes, more)
    scored = g.withColumn("_words", word_count(F.col("text"))).withColumn("score", title_score(F.col("_words"))).drop("_words")
    titles = best_titles(scored)
    return {"blocks": b, "groups": groups, "stats": stats, "scored": scored, "titles": titles}


def classify_groups(scored: DataFrame, titles: DataFrame) -> DataFrame:
    """J6 + F10 on every group: groups equal to the title text (running
    headers included) and texts under 3 characters are body; the others
    get the rule level. Adds title, excluded, level, is_heading."""
    g = scored.join(titles.select("doc_id", "title").hint("shuffle_hash"), "doc_id", "left")
    excluded = (F.col("text") == F.coalesce(F.col("title"), F.lit(""))) | (F.length("text") < TITLE_MIN_CHARS)
    g = g.withColumn("excluded", excluded)
    g = g.withColumn("level", F.when(F.col("excluded"), F.lit("body")).otherwise(heading_level()))
    return g.withColumn("is_heading", F.col("level") != "body")


def rule_headings(scored: DataFrame, titles: DataFrame) -> DataFrame:
    """ML9: outline rows by rules (confidence 0.7): the groups that ``classify_groups`` finds to be
    headings. The level does not depend on the title, so only groups of a level meet the titles."""
    # a shorter or longer text is no heading, whatever else holds
    g = scored.filter(F.length("text").between(TITLE_MIN_CHARS, HEADING_MAX_CHARS)).withColumn("_words", word_count(F.col("text")))
    g = g.withColumn("level", heading_level(words=F.col("_words"))).filter(F.col("level") != "body").select("doc_id", "page", "first_y0", "first_seq", "text", "level")
    g = g.join(titles.select("doc_id", "title").hint("shuffle_hash"), "doc_id", "left")
    return g.filter(F.col("text") != F.coalesce(F.col("title"), F.lit(""))).drop("title").withColumn("confidence", F.lit(RULE_CONFIDENCE))


def outlines(docs: DataFrame, titles: DataFrame, headings: DataFrame) -> DataFrame:
    """One nested outline per document (the output format is one
    object per document). ``docs`` lists every document (doc_id)."""
    entries = headings.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "page", "first_y0", "first_seq", "text", "level", "confidence"))).alias("h"))
    out = docs.select("doc_id").join(titles.select("doc_id", "title"), "doc_id", "left").join(entries, "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(
            F.transform("h", lambda x: F.struct(
                x["text"].alias("text"), x["level"].alias("level"), x["page"].alias("page"),
                x["confidence"].cast("double").alias("confidence"))),
            F.array().cast("array<struct<text:string,level:string,page:int,confidence:double>>"),
        ).alias("outline"),
    )


def outline_coverage(outlines_df: DataFrame, sample: int | None = None) -> DataFrame:
    """A10 / ML11: share of documents with a title / with a non-empty
    outline (NULL on no documents). ``sample`` takes that many documents,
    the first by key (SRC11; the source's sample has 50); all by default."""
    if sample is not None:
        outlines_df = outlines_df.orderBy("doc_id").limit(sample)
    return outlines_df.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg((F.col("title") != "").cast("double")).alias("title_rate"),
        F.avg((F.size("outline") > 0).cast("double")).alias("heading_rate"),
    )
