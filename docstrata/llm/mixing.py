"""Mixing sources to target weights on a time-varying curriculum.

Targets. Sources in code point order (null last) weigh 1, 2, 3 and again;
they share the words of the whole table by weight, and what would exceed
``max_epochs`` times a source is reshared among the others. The final level
has a closed form: with sources in order of cap / weight, the level is the
greatest of (total - caps before) / (weights from here on).

Curriculum. The words of a source lie on a line in an order given by a
hash; the source is read along this line, again and again, up to its
target. Each weight has a schedule, a rate over training time 0..1 that is
linear between knots. Its integral is the share of the target demanded by
a time; inverting it for a copy's first word gives the copy's training
position. Copies are range-sorted by position.

Scale. The line of a source is never one task: (source, hash prefix)
buckets are summed first (partial aggregation), bucket starts are prefix
sums over at most 4096 rows a source, and only inside a bucket a window
adds up documents. A source with a third of all rows is 4096 buckets.

Edge rows: null text has size 0; documents of size 0 are taken 0 times;
null sources are one source; rows that repeat are documents of their own,
next to each other on the line; an empty table gives an empty result.
Sizes and ``taken`` count words up to the target: whole copies but for one a
source, at its end. ``mixed_documents(whole=True)`` passes every text as it is: a
source is read whole as often as its target holds it, and the rest of the target
is filled along the line with documents that fit; one that does not is passed
over, and what it leaves is filled in the next of ``ROUNDS`` rounds; last, one
document more is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import MAX_LONG, WS, written
from docstrata.llm.exact import located

MAX_EPOCHS = 3
ROUNDS = 6
WEIGHTS = (1, 2, 3)
#: Rate of each weight over training time: knots (time, rate), linear between them.
SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, weight, source_size, target) from (source, size); one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    picks = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(picks, (rank % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / on)
    level = F.max("level").over(everything)
    return per.select("source", "weight", "source_size",
                      F.least(cap.cast("double"), F.col("weight") * level).alias("target"))


def _integral(knots: Sequence[tuple[float, float]]) -> list[float]:
    total = [0.0]
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        total.append(total[-1] + (r0 + r1) / 2 * (t1 - t0))
    return total


def position_of(share: F.Column, weight: F.Column, schedules: dict = SCHEDULES) -> F.Column:
    """Training time at which the integral of the weight's schedule reaches ``share`` of its total."""
    out = share  # a weight without a schedule is constant
    for w, knots in schedules.items():
        total = _integral(knots)
        here = F.lit(knots[-1][0])
        for (t0, r0), (t1, r1), low, high in reversed(list(zip(knots, knots[1:], total, total[1:]))):
            rest = share * total[-1] - low
            slope = (r1 - r0) / (t1 - t0)
            t = rest / r0 if not slope else (F.sqrt(F.greatest(F.lit(r0 * r0) + rest * 2 * slope, F.lit(0.0))) - r0) / slope
            here = F.when(share * total[-1] <= high, t + t0).otherwise(here)
        out = F.when(weight == w, here).otherwise(out)
    return out


def along(rows: DataFrame, out: str) -> DataFrame:
    """Adds to rows with dk, rid, source, size (and epoch, which comes first) the sum of the sizes
    before each on its source's line."""
    # documents without an id are dealt out by their text
    name = F.col("dk").cast("string")
    name = F.when(F.col("dk") == MAX_LONG, F.concat_ws(":", name, F.col("rid").cast("string"))).otherwise(name)
    rows = rows.withColumn("_h", F.md5(name))
    passed = F.col("epoch").cast("string") if "epoch" in rows.columns else F.lit("")
    rows = rows.withColumn("_bucket", F.concat(passed, F.substring("_h", 1, 3)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "dk", "rid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_s"]) & (rows["_bucket"] == starts["_b"]))
    return rows.withColumn(out, F.col("_start") + F.col("_in")).drop("_s", "_b", "_h", "_bucket", "_start", "_in")


def placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds weight, source_size, target and ``at`` (first word's place on the
    source's line) to rows with dk, rid, source, size."""
    targets = targets.withColumnRenamed("source", "_t")
    out = along(rows, "at")
    return out.join(targets, out["source"].eqNullSafe(targets["_t"])).drop("_t")


def whole_copies(rows: DataFrame, keys: list[str], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(keys, weight, at, want, source_size, passes, more) of the placed rows that whole copies are
    taken of: ``passes`` of all of a source, and more of those that fill its target, ``max_epochs`` at most."""
    rows = rows.where("size > 0").withColumn("want", F.round("target").cast("long"))
    rows = rows.withColumn("passes", F.floor(F.col("want") / F.col("source_size")).cast("int"))
    rows = written(rows.withColumn("gap", F.col("want") - F.col("passes") * F.col("source_size")), "mix-placed")
    todo = rows.select(*keys, "dk", "rid", "source", "size", "gap", F.sequence(F.lit(1), F.lit(max_epochs)).alias("e"), "passes").where("size <= gap")
    todo = todo.select("*", F.explode(F.filter("e", lambda e: e > F.col("passes"))).alias("epoch")).drop("e", "passes")
    picked = []
    for _ in range(ROUNDS):
        now = along(todo, "to").withColumn("fits", F.col("to") + F.col("size") <= F.col("gap"))
        now = written(now, "mix-round")
        picked.append(now.where("fits").select(*keys))
        used = now.groupBy(F.col("source").alias("_u")).agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("_used"))
        todo = now.where("NOT fits").drop("to", "fits").join(used, F.col("source").eqNullSafe(F.col("_u"))).withColumn(
            "gap", F.col("gap") - F.col("_used")).drop("_u", "_used").where("size <= gap")
        todo = written(todo, "mix-open")
        if todo.isEmpty():
            break
    more = picked[0]
    for p in picked[1:]:
        more = more.unionByName(p)
    more = more.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).cast("int").alias("_more"))
    out = written(rows.join(more, [F.col(k) == F.col(f"_{k}") for k in keys], "left").withColumn("more", F.coalesce("_more", F.lit(0))), "mix-picked")
    # last, the document that comes nearest to what is left, if it brings the source nearer to its target
    left = out.groupBy(F.col("source").alias("_u")).agg((F.max("gap") - F.sum(F.col("more") * F.col("size"))).alias("_left"))
    open_ = out.where(F.col("passes") + F.col("more") < max_epochs).join(left, F.col("source").eqNullSafe(F.col("_u"))).where("_left > 0 AND size < 2 * _left")
    best = open_.groupBy("source").agg(F.min_by(F.struct(*keys), F.struct(F.abs(F.col("size") - F.col("_left")).alias("off"), "dk", "rid", *keys)).alias("b"))
    best = best.select(*[F.col(f"b.{k}").alias(f"_{k}_") for k in keys], F.lit(1).alias("_one"))
    out = out.join(best, [F.col(k) == F.col(f"_{k}_") for k in keys], "left").withColumn("more", F.col("more") + F.coalesce("_one", F.lit(0)))
    return out.select(*keys, "dk", "rid", "weight", "at", "want", "source_size", "passes", "more").where("passes + more > 0")


def copy_words(epoch: int) -> F.Column:
    """Words that the mix takes from a document in one pass over its source."""
    left = F.round("target").cast("long") - F.col("at") - F.lit(epoch) * F.col("source_size")
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))


def _keys(docs: DataFrame) -> list[F.Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("dk"),
            F.xxhash64("text").alias("rid"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size")]


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
            schedules: dict = SCHEDULES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, position (of the first copy).

    Read off the mix: every copy gets its position and the copies are range-sorted by it,
    as ``mixed_documents`` does with the rows themselves, and written."""
    rows = written(docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row_id"), *_keys(docs)), "mix-sizes")
    targets = source_targets(rows, weights, max_epochs)
    # a document that is not taken stays as a row without a copy
    mix = _positioned(placed(rows, targets), max_epochs, schedules, outer=True)
    mix = written(mix.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(
        "row_id", "doc_id", "size", "source_size", "target", "copy", "position"), "mix-copies")
    out = mix.groupBy("row_id").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
                                    F.coalesce(F.sum("copy.words"), F.lit(0)).alias("taken"), F.min_by("position", "copy.epoch").alias("position"))
    return out.drop("row_id")


#: Order of the copies in the mix.
ORDER = ("position", "dk", "rid", "epoch")


def _positioned(rows: DataFrame, max_epochs: int, schedules: dict, outer: bool = False) -> DataFrame:
    """A row per copy of the placed rows: ``copy`` (epoch, words), epoch, and its training position."""
    copies = F.filter(F.array(*[F.struct(F.lit(k).alias("epoch"), copy_words(k).alias("words")) for k in range(max_epochs)]),
                      lambda c: c["words"] > 0)
    out = rows.withColumn("copy", (F.explode_outer if outer else F.explode)(copies)).withColumn("epoch", F.col("copy.epoch"))
    share = (F.col("at") + F.col("epoch") * F.col("source_size")) / F.greatest(F.round("target"), F.lit(1.0))
    return out.withColumn("position", position_of(share, F.col("weight"), schedules))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    schedules: dict = SCHEDULES, whole: bool = False, file_backed: bool = False) -> DataFrame:
    """The mix itself: the columns of docs, one row per copy, range-sorted by training position.

    Without ``whole`` the copy at a source's target keeps its first words only.
    ``file_backed``: docs is an unjoined scan of files, whose rows have a place."""
    if whole:
        return _mixed_whole(located(docs, file_backed), weights, max_epochs, schedules)
    sizes = written(docs.select(*_keys(docs)), "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)
    rows = docs.select(*_keys(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _positioned(placed(rows, targets), max_epochs, schedules).withColumn("row", _cut())
    return out.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("row.*")


def _mixed_whole(docs: DataFrame, weights: Sequence[int], max_epochs: int, schedules: dict) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    sizes = written(docs.select(*place, *_keys(docs)), "mix-sizes")
    taken = whole_copies(placed(sizes, source_targets(sizes, weights, max_epochs)), ["file", "place"], max_epochs)
    share = F.least((F.col("at") + F.col("epoch") * F.col("source_size")) / F.col("want"), F.lit(1.0))
    # 1 .. passes + more, so that a row with one copy is no descending sequence
    copies = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("passes") + F.col("more")))).withColumn("epoch", F.col("epoch") - 1)
    copies = copies.select(F.col("file").alias("_f"), F.col("place").alias("_p"), "dk", "rid", "epoch", position_of(share, F.col("weight"), schedules).alias("position"))
    rows = docs.select(*place, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(copies, (F.col("file") == F.col("_f")) & (F.col("place") == F.col("_p")))
    order = ["position", "dk", "rid", "epoch"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def _cut() -> F.Column:
    """The row of a copy; the one that the target cuts with its first words."""
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(f"[^{WS}]+"), F.lit(0)),
                                 F.lit(1), F.greatest(F.col("copy.words"), F.lit(1)).cast("int")), " ")
    return F.when(F.col("copy.words") < F.col("size"), F.col("row").withField("text", first)).otherwise(F.col("row"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM p),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM p) - coalesce(sum(source_size * 3) OVER (
               ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, weight, source_size, least((source_size * 3)::DOUBLE, weight * (SELECT max(level) FROM l)) AS target FROM l),
a AS (
  SELECT d.*, t.weight, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - first_word)) + greatest(0, least(size, round(target)::BIGINT - first_word - source_size))
            + greatest(0, least(size, round(target)::BIGINT - first_word - 2 * source_size)) AS taken,
         first_word / greatest(round(target), 1.0) AS u
  FROM a)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN CASE weight
         WHEN 1 THEN (sqrt(greatest(2.25 - 2 * u, 0.0)) - 1.5) / -1.0
         WHEN 2 THEN u
         ELSE CASE WHEN u <= 0.375 THEN sqrt(greatest(0.25 + 2 * u, 0.0)) - 0.5
                   ELSE sqrt(greatest(1.0 + 2 * (u - 0.375), 0.0)) - 1.0 + 0.5 END END END AS position
FROM k
"""
