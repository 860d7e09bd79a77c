"""Composite jobs (C1-C7): the three stages chained as DataFrames.

``Corpus`` builds each stage lazily from a layout-span table and keeps the
frames of one run, so the query registry and the bench can share plans.
Nothing is collected; stage outputs can be written (``write_stage``) as
tables in the shared checkpoint folder to cut lineage between stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import requests as R
from ..operators import structure as S
from ..sources import fixtures

#: Of the stages that hold all texts (spans, blocks): some two thirds of the default codec's bytes.
TEXT_CODEC = "zstd"


class Corpus:
    """Stages over one span table. ``spans`` (D1) is required; the TOC
    lines, language profiles and requests are optional inputs."""

    def __init__(self, spans: DataFrame, toc_lines: DataFrame | None = None,
                 language_profiles: DataFrame | None = None,
                 requests: DataFrame | None = None, request_docs: DataFrame | None = None,
                 cluster_columns: bool = False, materialize: bool = True, model=None, section_model=None,
                 text_model=None, memo_path: str | None = None, derived: bool = False):
        self._spans = spans
        #: The spans are made from other tables: they are written before the stages read them.
        self.derived = derived
        self.toc_lines = toc_lines
        self.language_profiles = language_profiles
        self.requests = requests
        self.request_docs = request_docs
        self.cluster_columns = cluster_columns
        self.materialize = materialize
        #: StructureModel that finds the headings in place of the rules.
        self.model = model
        #: Batch function prompts -> responses that finds the sections in place of the scores (UD1).
        self.section_model = section_model
        #: Batch function that writes the text of a kept section (second prompt), and the
        #: folder of the answers that both functions have given so far.
        self.text_model = text_model
        self.memo_path = memo_path

    @cached_property
    def spans(self) -> DataFrame:
        """D1. Blocks, statistics and documents each read the spans; derived ones would be
        made again by each, and an input of one row group be read by one task each time."""
        return self._cut(self._spans, TEXT_CODEC) if self.derived else self._spans

    def _cut(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """Stage boundary: the stage output is written once as a Parquet
        table in the shared checkpoint folder and read back (the reference
        writes a file per document at the same points)."""
        return write_stage(df, codec=codec) if self.materialize else df

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, with_toc: bool = False,
                      with_requests: bool = True) -> "Corpus":
        return cls(
            fixtures.fx_spans(spark, sf_dir),
            toc_lines=fixtures.fx_toc_lines(spark, sf_dir) if with_toc else None,
            requests=fixtures.fx_requests(spark, sf_dir) if with_requests else None,
            request_docs=fixtures.fx_request_docs(spark, sf_dir) if with_requests else None,
            derived=True,
        )

    @classmethod
    def from_blocks(cls, blocks: DataFrame | None, docs: DataFrame, **parts) -> "Corpus":
        """Stages 2 and 3 over given blocks (``doc_id``) and documents (``doc_id, doc_key``);
        ``parts``: the constructor's options, and stage outputs that are already there."""
        made = {k: parts.pop(k) for k in ("headings", "classified", "titles") if k in parts}
        c = cls(None, **parts)
        c.__dict__.update(made, docs=docs, **({} if blocks is None else {"blocks": blocks}))
        return c

    # ---- stage 1 -------------------------------------------------------
    @cached_property
    def blocks(self) -> DataFrame:
        """D2 block records."""
        if self.language_profiles is None:
            return self._cut(B.blocks_from_spans(self.spans, toc_lines=self.toc_lines,
                                                 cluster_columns=self.cluster_columns), TEXT_CODEC)
        # F2 reads the written block table (cheap to read twice); a merged
        # block keeps the language of its anchor's own text.
        base = self._cut(B.blocks_from_spans(self.spans, toc_lines=self.toc_lines,
                                             cluster_columns=self.cluster_columns, keep=("anchor_text",)), TEXT_CODEC)
        cols = [c for c in base.columns if c != "anchor_text"]
        return self._cut(B.add_language(base, self.language_profiles).select(*cols), TEXT_CODEC)

    @cached_property
    def docs(self) -> DataFrame:
        """Every document of the input (also those without a block)."""
        return self._cut(self.spans.select("doc_id").distinct().withColumn(
            "doc_key", F.col("doc_id").cast("string")))

    # ---- stage 2 -------------------------------------------------------
    @cached_property
    def _structure(self) -> dict[str, DataFrame]:
        return S.structure(self.blocks)

    @property
    def groups(self) -> DataFrame:
        return self._structure["groups"]

    @property
    def stats(self) -> DataFrame:
        return self._structure["stats"]

    @cached_property
    def scored(self) -> DataFrame:
        return self._cut(self._structure["scored"])

    @cached_property
    def best_titles(self) -> DataFrame:
        """The best candidate of each document that has one above the cut."""
        return S.best_titles(self.scored)

    @cached_property
    def titles(self) -> DataFrame:
        """ML10 title of every document ('' when none)."""
        return self.docs.join(self.best_titles, "doc_id", "left").select(
            "doc_id", F.coalesce("title", F.lit("")).alias("title"), "title_score", "title_confidence")

    @cached_property
    def classified(self) -> DataFrame:
        return self._cut(S.classify_groups(self.scored, self.titles))

    @cached_property
    def headings(self) -> DataFrame:
        """ML9 outline rows (flat); with a model, ML8's."""
        if self.model is not None:
            from ..operators import model as M

            return self._cut(M.predict_headings(self.model, self.scored, self.titles))
        if "classified" not in self.__dict__:
            return self._cut(S.rule_headings(self.scored, self.titles))
        return self.classified.filter("is_heading").select(
            "doc_id", "page", "first_y0", "first_seq", "text", "level",
            F.lit(S.RULE_CONFIDENCE).alias("confidence"))

    @cached_property
    def outlines(self) -> DataFrame:
        """Nested outline per document."""
        return S.outlines(self.docs, self.titles, self.headings)

    # ---- stage 3 -------------------------------------------------------
    @cached_property
    def candidates(self) -> DataFrame:
        if self.section_model is not None:
            p = R.prompts(self.requests, self.request_docs, self.docs, self.headings)
            return R.hook_sections(p, self.section_model, self.memo_path).drop("from_model")
        return R.candidate_sections(self.requests, self.request_docs, self.docs, self.headings)

    @cached_property
    def kept(self) -> DataFrame:
        return self._cut(R.top_sections(self.candidates))

    @cached_property
    def kept_with_text(self) -> DataFrame:
        if self.text_model is not None:
            from ..operators.generator import generated_texts
            from ..session import ensure_checkpoint_dir

            memo = self.memo_path or f"{ensure_checkpoint_dir(self.kept.sparkSession).rstrip('/')}/memo-{id(self)}"
            return self._cut(generated_texts(self.kept, self.requests, self.headings, self.text_model, memo, R.fallback_text))
        # only documents of a kept section give texts
        docs = self.kept.filter(~F.col("is_fallback")).select("doc_id").distinct()
        if "classified" in self.__dict__:
            classified = self.classified.join(docs, "doc_id", "left_semi")
        else:
            classified = S.classify_groups(self.scored.join(docs, "doc_id", "left_semi"), self.titles)
        if self.model is not None:  # a section starts at a heading of the model
            at = ["doc_id", "page", "first_y0", "first_seq"]
            heads = self.headings.select(*at, F.lit(True).alias("found"))
            classified = classified.drop("is_heading").join(heads, at, "left").withColumn(
                "is_heading", F.coalesce("found", F.lit(False))).drop("found")
        sectioned = R.assign_sections(classified)
        return R.refined_texts(self.kept, self.requests, sectioned)

    def answers(self, timestamp: str = "1970-01-01T00:00:00") -> DataFrame:
        """C6 / SNK3: one D6 answer per request."""
        return R.answers(self.requests, self.request_docs, self.kept_with_text, timestamp)


def write_stage(df: DataFrame, name: str | None = None, mode: str = "overwrite", codec: str | None = None) -> DataFrame:
    """Write a stage output as Parquet in the shared checkpoint folder and
    read it back (cuts lineage; survives executor loss; one computation).
    ``codec``: in place of the session's."""
    import uuid

    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/stages/{name or uuid.uuid4().hex}"
    df.write.mode(mode).parquet(path, compression=codec)
    return spark.read.parquet(path)
