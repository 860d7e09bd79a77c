"""UD1: calls of a generator (a user function) through a memo table.

Prompts are told apart by hash; each distinct prompt that the memo does not
hold yet is asked once, in rounds, and the answers of a round are appended to
the memo when it ends. A later stage, another request or a repeated run finds
them there. A call has a time limit; one that fails or does not come back in
time gives null, which is remembered with its reason and asked again only on
demand. If a machine is lost, the prompts of its unfinished tasks are asked
again, no others.

The prompt for a section's text follows the sections: where its answer is
missing, the text is the document's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as CallTimeout

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws
from .requests import request_terms, tokens

#: Seconds that a call may take.
TIME_LIMIT = 120.0
#: Prompts of a call (the function takes a Series of prompts); with 1 a failure costs one prompt only.
CALL_SIZE = 16
ROUNDS = 4
MEMO = "prompt_hash string, response string, error string"

ModelFn = Callable[[pd.Series], pd.Series]


def prompt_hash(prompt) -> F.Column:
    return F.sha2(prompt, 256)


def _called(model_fn: ModelFn, prompts: pd.Series, limit: float) -> tuple[list[str | None], str | None]:
    """The answers of one call, or the reason why there are none. A call that hangs keeps its thread until the worker ends."""
    pool = ThreadPoolExecutor(1)
    try:
        got = pool.submit(model_fn, prompts).result(timeout=limit)
        out = [None if x is None or x != x else str(x) for x in list(got)]
        if len(out) != len(prompts):
            return [None] * len(prompts), f"{len(out)} answers to {len(prompts)} prompts"
        return out, None
    except CallTimeout:
        return [None] * len(prompts), f"no answer in {limit:g} s"
    except Exception as e:  # noqa: BLE001 - whatever the user's function raises is this call's failure
        return [None] * len(prompts), f"{type(e).__name__}: {e}"
    finally:
        pool.shutdown(wait=False)


def _asked(model_fn: ModelFn, limit: float, call_size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), call_size):
                part = pdf.iloc[at: at + call_size]
                answers, error = _called(model_fn, part["prompt"].reset_index(drop=True), limit)
                yield pd.DataFrame({"prompt_hash": list(part["prompt_hash"]), "response": pd.Series(answers, dtype=object),
                                    "error": pd.Series([error if a is None else None for a in answers], dtype=object)})

    return run


def memo_table(spark, path: str) -> DataFrame:
    """The memo so far: one row a prompt, an answer rather than a failure."""
    from ..plans.manifest import Store

    if not Store(spark, path).folders(path):
        return spark.createDataFrame([], MEMO)
    rows = spark.read.schema(MEMO).parquet(f"{path}/round=*")
    return rows.groupBy("prompt_hash").agg(
        F.min_by(F.struct("response", "error"), F.struct(F.col("response").isNull(), "response")).alias("a")).select("prompt_hash", "a.*")


def responses(prompts: DataFrame, model_fn: ModelFn, memo_path: str, limit: float = TIME_LIMIT, call_size: int = CALL_SIZE,
              rounds: int = ROUNDS, again: bool = False) -> DataFrame:
    """``prompts`` (with a column ``prompt``) with ``response``; ``again`` asks the failed ones once more."""
    import uuid

    spark = prompts.sparkSession
    rows = prompts.withColumn("prompt_hash", prompt_hash("prompt"))
    known = memo_table(spark, memo_path)
    held = known.filter("response IS NOT NULL") if again else known
    new = rows.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(held.select("prompt_hash"), "prompt_hash", "left_anti")
    # the list of what to ask is fixed before the first round changes the memo
    from ..plans.pipeline import write_stage

    new = write_stage(new.withColumn("_round", F.pmod(F.xxhash64("prompt_hash"), F.lit(rounds))))
    mark = uuid.uuid4().hex
    for k in range(rounds):
        part = new.filter(F.col("_round") == k).select("prompt_hash", "prompt")
        part.mapInPandas(_asked(model_fn, limit, call_size), MEMO).write.parquet(f"{memo_path}/round={mark}-{k}")
    return rows.join(memo_table(spark, memo_path).select("prompt_hash", "response"), "prompt_hash", "left").drop("prompt_hash")


# ---- second prompt: the text of a section ------------------------------------


def section_prompts(kept: DataFrame, requests: DataFrame, content: DataFrame) -> DataFrame:
    """F8: a prompt for the text of each kept section; ``content`` is A12 (doc_id, content)."""
    rows = kept.join(requests, "request_id").join(content, "doc_id", "left")
    prompt = F.format_string(
        "You are a %s. Your task is: %s\n\nWrite on the section \"%s\" of the document \"%s\" what helps with the task, "
        "in paragraphs without lists.\n\nDocument content:\n%s",
        F.coalesce("persona", F.lit("")), F.coalesce("task", F.lit("")), F.coalesce("section_title", F.lit("")), "filename",
        F.coalesce("content", F.lit("")))
    return rows.withColumn("prompt", prompt).drop("content")


def document_texts(kept: DataFrame, requests: DataFrame, content_rows: DataFrame) -> DataFrame:
    """Text for a section that has no place in the document: of the document's headings
    (doc_id, page, first_y0, first_seq, text), those that share a term with the
    section's title, else with the request; null if none does."""
    names = kept.select("request_id", "doc_id", "section_title", F.array_distinct(tokens(F.coalesce("section_title", F.lit("")))).alias("own"))
    asked = request_terms(requests).groupBy("request_id").agg(F.collect_set("term").alias("asked"))
    rows = names.join(asked, "request_id", "left").join(
        content_rows.select("doc_id", "page", "first_y0", "first_seq", "text", tokens(F.col("text")).alias("words")), "doc_id")
    place = F.struct("page", "first_y0", "first_seq", "text")

    def sharing(terms: str) -> F.Column:
        return F.sort_array(F.collect_list(F.when(F.arrays_overlap("words", terms), place)))

    texts = rows.groupBy("request_id", "doc_id", "section_title").agg(sharing("own").alias("a"), sharing("asked").alias("b"))
    chosen = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))
    text = collapse_ws(F.array_join(F.transform(chosen, lambda x: x["text"]), " "))
    return texts.select("request_id", "doc_id", "section_title", F.when(text != "", text).alias("document_text"))


def generated_texts(kept: DataFrame, requests: DataFrame, headings: DataFrame, model_fn: ModelFn, memo_path: str, fallback: Callable,
                    **options) -> DataFrame:
    """ML13 by a generator: kept sections with ``refined_text``, the answer to the second
    prompt with white space collapsed, else the document's text, else ``fallback(filename, task)``."""
    from .requests import text_content

    answered = responses(section_prompts(kept, requests, text_content(headings)), model_fn, memo_path, **options)
    own = document_texts(kept, requests, headings)
    out = answered.join(own, (answered["request_id"] == own["request_id"]) & (answered["doc_id"] == own["doc_id"])
                        & answered["section_title"].eqNullSafe(own["section_title"]), "left").select(answered["*"], own["document_text"])
    said = collapse_ws(F.coalesce("response", F.lit("")))
    text = F.coalesce(F.when(said != "", said), F.col("document_text"), fallback(F.col("filename"), F.col("task")))
    return out.withColumn("refined_text", text).drop("prompt", "response", "document_text", "persona", "task")
