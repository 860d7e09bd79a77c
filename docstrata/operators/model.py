"""ML1-ML8, A9, A11, O5, SNK4: heading / title classifiers with Spark ML.

Weak labels come from the rule path (ML1). Features are the 36 group
columns (F12), assembled and scaled by a Spark ML pipeline fitted on the
training part only (the reference fits the scaler before the split; we do
not). The title classifier is gradient-boosted trees, the heading
classifier a random forest with balanced class weights. The split is a
hash of the group key, so it repeats on any partitioning. Sizes default to
the reference values; callers may pass smaller ones.
"""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import structure as S
from .features import FEATURE_COLS, FEATURES, numeric_features

# Fixed values (reference defaults).
TEST_FRACTION = 0.2
SEED = 42
#: Training rows of a heading class that the classifiers are fitted on.
SAMPLE_ROWS = 50_000
HEADING_MIN_PROB = 0.2
TITLE_PARAMS = dict(maxIter=200, maxDepth=8, stepSize=0.1, subsamplingRate=0.8)
HEADING_PARAMS = dict(numTrees=200, maxDepth=15, minInstancesPerNode=2)

GROUP_KEY = ["doc_id", "page", "first_y0", "first_seq"]


def weak_labels(scored: DataFrame, cutoff: float = S.TITLE_CUTOFF_LABEL) -> DataFrame:
    """ML1: title label = the group's text equals the best candidate of a
    document whose best score > cutoff; heading label by the rules with
    that title flag."""
    best = S.best_titles(scored, cutoff=cutoff).select("doc_id", F.col("title").alias("label_title"))
    g = scored.join(best.hint("shuffle_hash"), "doc_id", "left")
    is_title = (F.coalesce(F.col("label_title"), F.lit("")) != "") & (F.col("text") == F.col("label_title"))
    return g.withColumn("title_label", is_title.cast("int")).withColumn(
        "heading_label", S.heading_level(is_title)).drop("label_title")


def class_weights(labels: DataFrame, col: str) -> DataFrame:
    """Balanced weights n / (classes * count) per class. The window runs
    over the per-class counts (one row per class)."""
    from pyspark.sql import Window

    counts = labels.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy()
    return counts.select(
        col, "n",
        (F.sum("n").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n"))).alias("weight"))


def label_index(labels: DataFrame) -> DataFrame:
    """ML3: alphabetical label encoding (fitted StringIndexer)."""
    from ..plans.pipeline import write_stage

    names = write_stage(labels.select("heading_label").distinct())  # read by the fit and by the encoding
    ix = StringIndexer(inputCol="heading_label", outputCol="label_index", stringOrderType="alphabetAsc").fit(names)
    return ix.transform(names)


def with_features(scored: DataFrame) -> DataFrame:
    return scored.select("*", *numeric_features())


def split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """ML4: repeatable hash split by group (not by document); the first 28
    bits of an MD5 of the seed and the group's place."""
    h = split_share(seed)
    return df.filter(h >= test_fraction), df.filter(h < test_fraction)


def split_share(seed: int = SEED):
    """A number in [0, 1) from the group key."""
    place = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("doc_id", "page", "first_seq")])
    return F.conv(F.substring(F.md5(place), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def stratified_sample(rows: DataFrame, stratum: str, size: int, seed: int = SEED) -> DataFrame:
    """The rows of least hash of each class, ``size`` of them or all if it has fewer.

    Bottom-k samples merge: of the parts of a class each gives its own least
    ``size`` rows, and of those the least stay, so that the sample is the
    same on any partitioning (``topk.top_k``)."""
    from .topk import top_k

    place = F.concat_ws(":", F.lit(f"fit {seed}"), *[F.col(c).cast("string") for c in ("doc_id", "page", "first_seq")])
    marked = rows.withColumn("_h", F.md5(place))
    order = [F.col("_h"), F.col("doc_id"), F.col("page"), F.col("first_seq")]
    return top_k(marked, [stratum], order, size, GROUP_KEY, rank_col="_rank").drop("_h", "_rank")


def dealt(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows dealt out evenly by their key, in an order of their own: a fit makes a job for
    each level of each tree, and lasts as long as the largest part of each. The sample comes
    from a window with a part for each class."""
    if parts is None:
        try:
            parts = rows.sparkSession.sparkContext.defaultParallelism
        except Exception:  # noqa: BLE001 - no SparkContext (Connect): as Spark deals them
            return rows.repartition(*GROUP_KEY).sortWithinPartitions(*GROUP_KEY)
    return rows.repartition(parts, *GROUP_KEY).sortWithinPartitions(*GROUP_KEY)


class StructureModel:
    """Two fitted pipelines (title, heading) plus the label order."""

    def __init__(self, title: PipelineModel, heading: PipelineModel, labels: list[str],
                 heading_threshold: float = HEADING_MIN_PROB):
        self.title = title
        self.heading = heading
        self.labels = labels
        self.heading_threshold = heading_threshold

    @property
    def name(self) -> str:
        """Changes with what was fitted: for the fingerprints of stages."""
        return f"{self.title.uid} {self.heading.uid} {self.heading_threshold}"

    def save(self, path: str) -> None:
        """SNK4: Spark ML persistence plus the thresholds as JSON."""
        self.title.write().overwrite().save(f"{path}/title")
        self.heading.write().overwrite().save(f"{path}/heading")
        from pyspark.sql import SparkSession

        s = SparkSession.getActiveSession()
        s.createDataFrame([(json.dumps({"labels": self.labels, "heading_threshold": self.heading_threshold}),)],
                          "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, path: str) -> "StructureModel":
        from pyspark.sql import SparkSession

        s = SparkSession.getActiveSession()
        meta = json.loads(s.read.text(f"{path}/meta").first()[0])
        return cls(PipelineModel.load(f"{path}/title"), PipelineModel.load(f"{path}/heading"),
                   meta["labels"], meta["heading_threshold"])


def fit_structure_model(labelled: DataFrame, title_params: dict | None = None,
                        heading_params: dict | None = None, seed: int = SEED, sample_rows: int = SAMPLE_ROWS) -> tuple[StructureModel, DataFrame]:
    """ML7: fit both classifiers on the training part, on ``sample_rows`` rows of
    each heading class at most (a row then stands for more of its class and weighs
    as much); returns the model and the whole held-out part (for A11). Label index and class weights come from
    all rows, so that a class met in the held-out part only has its index;
    features are computed once, into a written table. Raises if the title
    label has one class only (the boosting fit needs two)."""
    from ..plans.pipeline import write_stage

    tp = {**TITLE_PARAMS, **(title_params or {})}
    hp = {**HEADING_PARAMS, **(heading_params or {})}
    weights = class_weights(labelled, "heading_label").select("heading_label", F.col("weight").alias("w"))
    assembler = VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features")
    data = write_stage(with_features(labelled).join(weights, "heading_label"))
    train, test = split(data)
    n_title_classes = train.select("title_label").distinct().count()
    if n_title_classes < 2:
        raise ValueError("title labels have a single class; the title classifier needs two")
    chosen = stratified_sample(train, "heading_label", sample_rows, seed)
    stands = train.groupBy("heading_label").agg(F.greatest(F.count(F.lit(1)) / F.lit(float(sample_rows)), F.lit(1.0)).alias("stands_for"))
    train = write_stage(dealt(chosen.join(stands, "heading_label").withColumn("w", F.col("w") * F.col("stands_for"))))
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True).fit(
        assembler.transform(train))
    indexer = StringIndexer(inputCol="heading_label", outputCol="label_idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep").fit(data)
    gbt = GBTClassifier(featuresCol="features", labelCol="title_label", weightCol="stands_for", seed=seed, **tp)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="w",
                                featureSubsetStrategy="sqrt", seed=seed, **hp)
    pipelines = [Pipeline(stages=[assembler, scaler, gbt]), Pipeline(stages=[assembler, scaler, indexer, rf])]
    # the boosting's jobs are small and follow each other; the forest's fill the cores meanwhile
    with ThreadPool(len(pipelines)) as pool:
        title, heading = pool.map(inheritable_thread_target(train.sparkSession)(lambda p: p.fit(train)), pipelines)
    labels = list(heading.stages[2].labels)
    return StructureModel(title, heading, labels), test


def predict_headings(model: StructureModel, scored: DataFrame, titles: DataFrame) -> DataFrame:
    """ML8: most probable class per group; kept when not body and its
    probability > threshold; groups equal to the title are skipped."""
    data = with_features(scored).join(titles.select("doc_id", "title"), "doc_id", "left")
    pred = model.heading.transform(data)
    conv = IndexToString(inputCol="prediction", outputCol="level", labels=model.labels)
    pred = conv.transform(pred).withColumn("prob", F.array_max(vector_to_array(F.col("probability"))))
    keep = (F.col("text") != F.coalesce(F.col("title"), F.lit(""))) & (F.col("level") != "body") & (
        F.col("prob") > model.heading_threshold)
    return pred.filter(keep).select("doc_id", "page", "first_y0", "first_seq", "text", "level",
                                    F.lit(None).cast("double").alias("confidence"))


def accuracy(model: StructureModel, test: DataFrame) -> DataFrame:
    """Held-out accuracy of both classifiers (one row)."""
    t = model.title.transform(test).withColumnRenamed("prediction", "title_pred").drop(
        "raw_features", "features", "rawPrediction", "probability")
    h = model.heading.transform(t)
    return h.agg(
        F.avg((F.col("title_pred") == F.col("title_label")).cast("double")).alias("title_accuracy"),
        F.avg((F.col("prediction") == F.col("label_idx")).cast("double")).alias("heading_accuracy"),
        F.count(F.lit(1)).alias("n_test"))


def top_features(model: StructureModel, k: int = 10) -> DataFrame:
    """The k most important features of the title classifier (the
    importance vector has one entry per feature: 36 rows at most)."""
    from pyspark.sql import SparkSession

    imp = model.title.stages[-1].featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    df = s.createDataFrame(list(zip(FEATURES, [float(v) for v in imp])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)
