"""Filter interaction audit: every order of the filters, enumerated by a recursive CTE.

Five filters, named by letters, give each document a mask of the conditions it
fails. Documents are counted in cells of (part, mask); all further work is on
cells. A recursive CTE starts with the empty prefix of each part and extends a
prefix by each filter it does not hold yet: it joins the part's cells, carries
the bits applied so far, and each level of the recursion emits the metrics of
that step. The steps of an order are those of its prefixes.

Filter E (a text that a smaller doc_id has) needs no join of documents: rows are
counted by (digest of the text, part, bits), with the least id and its rows, and
the least id of all of a digest is the one that passes.

Scale. Texts stay in the scan; one slim row a document is shuffled, twice
pre-aggregated, so that neither a repeated row nor a text with a third of all
rows lands in one task. A digest is left with as many rows as it has parts and
bits; a part with 32 cells and 325 prefixes.

Edge rows: null text is empty, null lang the part ''; a null id comes after all
others, and of rows without id none comes before the other; rows that repeat
are counted each, and one does not make the other fail E; a document of several
label rows has a label that one of them gives; an empty table gives an empty
result; only doc_id, text, lang and doc_id, quality, toxic are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.llm.common import MAX_LONG, WS, WS_CHARS, written

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SYMBOLS = r"[#$%&*|]"
NULL_SALTS = 4096
#: A part has 326 prefixes; the number of parts is not bounded here.
RECURSION = {"spark.sql.cteRecursionRowLimit": "-1"}


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_mask(text: F.Column) -> F.Column:
    """Bits of the conditions A to D, which rest on the text alone."""
    core = F.btrim(text, F.lit(WS_CHARS))
    words = F.split(core, f"[{WS}]+")
    n = F.when(core == "", 0).otherwise(F.size(words))
    distinct = F.when(core == "", 0).otherwise(F.size(F.array_distinct(words)))
    failed = {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * n,
              "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text), "D": text.rlike(SYMBOLS)}
    mask = F.lit(0)
    for letter, condition in failed.items():
        mask = mask + F.when(condition, bit(letter)).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell, those of quality 1 and the toxic ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = slim.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # null ids have no label; a salt deals them out
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0)
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("salt", salt)
    named = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = named.withColumn("label_salt", F.lit(0).cast("long"))
    rows = rows.join(named, (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    dk = F.coalesce("doc_id", F.lit(MAX_LONG))
    copies = rows.select("digest", "part", "mask", *flags, "n", dk.alias("dk")).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("dk").alias("least"), F.min(F.struct("dk", "n")).alias("own"))
    first = F.min("least").over(Window.partitionBy("digest"))
    copies = copies.withColumn("passing", F.when(F.col("least") == first, F.col("own.n")).otherwise(F.lit(0)))
    cell = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    cells = copies.select("part", "good", "toxic", F.explode(cell).alias("c")).groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))
    return cells.where("n > 0")


#: Documents of a part's cells that meet a condition, summed over one of their counts.
_SUM = "aggregate(filter(c.cells, x -> {0}), 0L, (a, x) -> a + x.{1})"
_NOW = "((s.applied | s.new) & x.mask)"
_HERE = "(x.mask & s.new) <> 0 AND (x.mask & s.applied) = 0"
STEPS_SQL = f"""
WITH RECURSIVE steps(part, prefix, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, s.next), s.step + 1, s.applied | s.new, s.next,
         {_SUM.format(_NOW + " = 0", "n")}, {_SUM.format(_HERE, "n")},
         {_SUM.format("(x.mask & s.new) <> 0 AND (x.mask & s.applied) <> 0", "n")}, {_SUM.format("x.mask = s.new", "n")},
         {_SUM.format(_HERE, "good")}, {_SUM.format(_HERE, "toxic")}
  FROM (SELECT part, prefix, step, applied, i AS pos, substring('{LETTERS}', i + 1, 1) AS next, shiftleft(1, i) AS new
        FROM steps LATERAL VIEW explode(filter(sequence(0, {len(LETTERS) - 1}), k -> (applied & shiftleft(1, k)) = 0)) AS i) s
  JOIN {{cells}} c ON c.part = s.part)
SELECT * FROM steps WHERE step > 0
"""


@contextmanager
def _recursion(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in RECURSION}
    for k, v in RECURSION.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def prefix_steps(cells: DataFrame) -> DataFrame:
    """The metrics of the last step of every prefix of every order, by part."""
    parts = written(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "audit-cells")
    spark = cells.sparkSession
    with _recursion(spark):
        return written(spark.sql(STEPS_SQL, cells=parts), "audit-steps")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = prefix_steps(mask_cells(docs, labels))
    size = len(LETTERS)
    orders = steps.where(F.col("step") == size).select(
        F.col("part").alias("p"), F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("k"))
    orders = orders.withColumn("start", F.expr("substring(filter_order, 1, k)"))
    out = orders.join(steps, (F.col("p") == F.col("part")) & (F.col("start") == F.col("prefix")))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))  # 120 rows a window
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                      shapley.alias("shapley"))


AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS dk, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT dk, doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(dk) OVER (PARTITION BY t) AS least FROM d),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN dk > least THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
cells AS (
  SELECT m.part, m.mask, count(*) AS n, sum(coalesce(l.good, 0)) AS good, sum(coalesce(l.bad, 0)) AS bad
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY m.part, m.mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a JOIN f b ON b.letter <> a.letter JOIN f c ON c.letter NOT IN (a.letter, b.letter)
  JOIN f d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN f e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
places AS (
  SELECT o.filter_order, here.letter, here.bit, strpos(o.filter_order, here.letter) AS step,
         sum(CASE WHEN strpos(o.filter_order, f.letter) < strpos(o.filter_order, here.letter) THEN f.bit ELSE 0 END) AS before
  FROM orders o CROSS JOIN f here CROSS JOIN f GROUP BY o.filter_order, here.letter, here.bit),
steps AS (
  SELECT c.part, p.filter_order, p.step, p.letter,
         sum(CASE WHEN c.mask & (p.before::INTEGER + p.bit) = 0 THEN c.n ELSE 0 END) AS kept,
         sum(CASE WHEN c.mask & p.bit > 0 AND c.mask & p.before::INTEGER = 0 THEN c.n ELSE 0 END) AS removed,
         sum(CASE WHEN c.mask & p.bit > 0 AND c.mask & p.before::INTEGER > 0 THEN c.n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.mask = p.bit THEN c.n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN c.mask & p.bit > 0 AND c.mask & p.before::INTEGER = 0 THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN c.mask & p.bit > 0 AND c.mask & p.before::INTEGER = 0 THEN c.bad ELSE 0 END) AS toxic_lost
  FROM cells c CROSS JOIN places p GROUP BY c.part, p.filter_order, p.step, p.letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
