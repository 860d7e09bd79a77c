"""Stage 3: requests (persona, task, documents) -> ranked sections.

The reference asks a language model for the 1-2 most relevant sections of
each document and a text on each. Here the default answerer is a Spark
job: every heading of the named documents is scored against the request's
persona + task with BM25 (statistics per request, by joins and groupBy),
the best two per document are kept (O4), all requests are ranked at once
(O3, W6), and the text on each kept section is extractive: every group of
the section that shares a term with the request, in document order, or the
whole section when none does. A user batch function can replace the
section finder (``hook_sections``).

Top-k steps use the salted two-phase ``top_k`` so that a request naming
a third of all documents, or a document with a third of all headings, is
never ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, strip
from .scan import running
from .topk import top_k

# Fixed values (reference defaults).
MAX_SECTIONS_PER_DOC = 2
MAX_SECTIONS = 5
FALLBACK_RULES = [
    ("cities", "Major Cities Guide", 1, 1),
    ("things to do", "Activities and Attractions", 2, 2),
    ("cuisine", "Food and Dining", 3, 1),
    ("tips", "Travel Tips", 4, 1),
]
FALLBACK_DEFAULT = ("General Information", 5, 1)
# Relevance parameters (BM25).
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DIGITS = 9
TOKEN = r"[\p{L}\p{N}]+"

SEC_KEY = ["page", "first_y0", "first_seq"]


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def doc_key(filename: Column) -> Column:
    """File name -> key of its outline: the name with ``.pdf`` (lower case)
    read as ``.json``, without that ending; NULL when no outline file has the name."""
    name = F.replace(filename, F.lit(".pdf"), F.lit(".json"))
    return F.when(name.endswith(".json"), F.substring(name, F.lit(1), F.length(name) - 5))


def request_documents(request_docs: DataFrame) -> DataFrame:
    """Double names collapse to their first position."""
    return request_docs.groupBy("request_id", "filename").agg(F.min("doc_pos").alias("doc_pos")).withColumn(
        "doc_key", doc_key(F.col("filename")))


def join_outlines(request_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """Requested documents that have an outline (docs: doc_id, doc_key)."""
    return request_documents(request_docs).join(docs.select("doc_id", "doc_key"), "doc_key", "inner")


def missing_documents(request_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """Requested names without an outline (the warning side of J1)."""
    return request_documents(request_docs).join(docs.select("doc_key"), "doc_key", "left_anti")


def text_content(headings: DataFrame) -> DataFrame:
    """Outline texts of a document joined by newlines, in order."""
    return headings.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*SEC_KEY, "text"))), lambda x: x["text"]),
                     "\n").alias("content"))


def has_content(headings: DataFrame) -> DataFrame:
    """P20 without building the text: some heading text is non-blank."""
    return headings.groupBy("doc_id").agg(F.bool_or(strip(F.col("text")) != "").alias("has_content"))


def request_terms(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id",
        F.explode(F.array_distinct(tokens(F.concat_ws(" ", "persona", "task")))).alias("term"),
    )


def bm25_sections(requests: DataFrame, req_docs: DataFrame, headings: DataFrame,
                  k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """ML12 default: BM25 score of every heading of every requested document
    against the request terms; statistics (N, avgdl, df) per request.
    Output: request_id, doc_id, page, first_y0, first_seq, text, score (> 0)."""
    secs = headings.select("doc_id", *SEC_KEY, "text", F.size(tokens(F.col("text"))).alias("dl"))
    rd = req_docs.select("request_id", "doc_id")
    # Statistics of a document once, then one row per (request, document).
    per_doc = secs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
    per_req = rd.join(per_doc, "doc_id").groupBy("request_id").agg(
        F.sum("n").alias("n_sec"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    # Only postings of terms that some request asks for meet the requests, by document and term.
    asked = request_terms(requests)
    st = secs.select("doc_id", *SEC_KEY, "dl", F.explode(tokens(F.col("text"))).alias("term"))
    st = st.join(asked.select("term").distinct(), "term", "left_semi").groupBy(
        "doc_id", *SEC_KEY, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    matched = rd.join(asked, "request_id").join(st, ["doc_id", "term"])
    dfreq = matched.groupBy("request_id", "term").agg(F.count(F.lit(1)).alias("df"))
    m = matched.join(dfreq, ["request_id", "term"]).join(per_req, "request_id")
    idf = F.log(1 + (F.col("n_sec") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = m.groupBy("request_id", "doc_id", *SEC_KEY).agg(F.sum(part).alias("score"))
    return scored.withColumn("score", F.round("score", SCORE_DIGITS)).join(
        secs.select("doc_id", *SEC_KEY, "text"), ["doc_id", *SEC_KEY])


def fallback_section(filename: Column) -> Column:
    """section by file name when nothing else is found."""
    name = F.lower(filename)
    expr = None
    for needle, title, rank, page in FALLBACK_RULES:
        val = F.struct(F.lit(title).alias("section_title"), F.lit(rank).alias("importance_rank"),
                       F.lit(page).alias("page_number"))
        expr = F.when(name.contains(needle), val) if expr is None else expr.when(name.contains(needle), val)
    t, r, p = FALLBACK_DEFAULT
    return expr.otherwise(F.struct(F.lit(t).alias("section_title"), F.lit(r).alias("importance_rank"),
                                   F.lit(p).alias("page_number")))


def fallback_text(filename: Column, task: Column) -> Column:
    """text used when a section has no text of its own."""
    return F.format_string("This section from %s is relevant to the task: %s", filename, task)


def candidate_sections(requests: DataFrame, request_docs: DataFrame, docs: DataFrame,
                       headings: DataFrame) -> DataFrame:
    """Per request and document: up to two sections (rank 1, 2) by score,
    or one fallback section when the document has content and no heading
    shares a term with the request; documents without content give none."""
    rd = join_outlines(request_docs, docs)
    scored = bm25_sections(requests, rd, headings)
    order = [F.col("score").desc(), *[F.col(c) for c in SEC_KEY]]
    best = top_k(scored, ["request_id", "doc_id"], order, MAX_SECTIONS_PER_DOC,
                 ["request_id", "doc_id", *SEC_KEY], rank_col="importance_rank")
    best = best.join(rd.select("request_id", "doc_id", "filename", "doc_pos"), ["request_id", "doc_id"])
    real = best.select(
        "request_id", "doc_id", "filename", "doc_pos",
        F.col("text").alias("section_title"), "importance_rank", F.col("page").alias("page_number"),
        F.col("importance_rank").alias("pos_in_doc"), *SEC_KEY, F.lit(False).alias("is_fallback"),
    )
    found = best.select("request_id", "doc_id").distinct()
    content = has_content(headings).filter("has_content")
    fb = rd.join(content.select("doc_id"), "doc_id").join(found, ["request_id", "doc_id"], "left_anti")
    fb = fb.withColumn("f", fallback_section(F.col("filename"))).select(
        "request_id", "doc_id", "filename", "doc_pos",
        F.col("f.section_title").alias("section_title"), F.col("f.importance_rank").alias("importance_rank"),
        F.col("f.page_number").alias("page_number"), F.lit(1).alias("pos_in_doc"),
        *[F.lit(None).cast(t).alias(c) for c, t in zip(SEC_KEY, ["int", "double", "int"])],
        F.lit(True).alias("is_fallback"),
    )
    return real.unionByName(fb)


def top_sections(candidates: DataFrame, k: int = MAX_SECTIONS) -> DataFrame:
    """O3 + W6: all sections of a request by importance rank (request
    order breaks ties), first k kept and re-ranked 1..k."""
    order = [F.col("importance_rank").asc_nulls_last(), F.col("doc_pos"), F.col("pos_in_doc")]
    kept = top_k(candidates, ["request_id"], order, k, ["request_id", "doc_id", "pos_in_doc"],
                 rank_col="new_rank")
    return kept.withColumn("importance_rank", F.col("new_rank")).drop("new_rank")


def assign_sections(classified: DataFrame) -> DataFrame:
    """Each group's section = the last heading at or before it in the
    document (NULL before the first heading): a running value inside the
    page, then the last heading of earlier pages, which is the greatest,
    carried in bounded chunks of pages (``scan.running``)."""
    key = F.struct(*SEC_KEY)
    w = Window.partitionBy("doc_id", "page").orderBy("first_y0", "first_seq").rowsBetween(
        Window.unboundedPreceding, 0)
    g = classified.withColumn("in_page", F.last(F.when(F.col("is_heading"), key), ignorenulls=True).over(w))
    per_page = classified.groupBy("doc_id", "page").agg(F.max(F.when(F.col("is_heading"), key)).alias("last_h"))
    carry = running(per_page, ["doc_id"], "page", "last_h", "carried", how="max")
    g = g.join(carry, ["doc_id", "page"]).withColumn("section", F.coalesce("in_page", "carried"))
    return g.drop("in_page", "carried")


def refined_texts(kept: DataFrame, requests: DataFrame, sectioned: DataFrame) -> DataFrame:
    """J7 + ML13 default: for each kept section, its groups that share a
    request term (all of its groups when none does), joined in document
    order with white space collapsed (F4); fallback sections and empty
    texts get the F7 text."""
    real = kept.filter(~F.col("is_fallback")).select(
        "request_id", "doc_id", F.struct(*SEC_KEY).alias("section"))
    members = real.join(sectioned.select("doc_id", "section", "first_y0", "first_seq", "page", "text"),
                        ["doc_id", "section"])
    terms = request_terms(requests).groupBy("request_id").agg(F.collect_set("term").alias("terms"))
    members = members.join(terms, "request_id", "left").withColumn(
        "shares", F.coalesce(F.arrays_overlap(tokens(F.col("text")), F.col("terms")), F.lit(False)))
    ordered = lambda only: F.sort_array(F.collect_list(F.when(only, F.struct("page", "first_y0", "first_seq", "text"))))
    texts = members.groupBy("request_id", "doc_id", "section").agg(
        ordered(F.col("shares")).alias("sharing"), ordered(F.lit(True)).alias("all_groups"))
    chosen = F.when(F.size("sharing") > 0, F.col("sharing")).otherwise(F.col("all_groups"))
    texts = texts.select("request_id", "doc_id", "section",
                         collapse_ws(F.array_join(F.transform(chosen, lambda x: x["text"]), " ")).alias("refined_text"))
    out = kept.withColumn("section", F.struct(*SEC_KEY)).join(texts, ["request_id", "doc_id", "section"], "left")
    out = out.join(requests.select("request_id", "task"), "request_id", "left")
    return out.withColumn(
        "refined_text",
        F.when(F.coalesce(F.col("refined_text"), F.lit("")) == "", fallback_text(F.col("filename"), F.col("task")))
        .otherwise(F.col("refined_text")),
    ).drop("section", "task")


def answers(requests: DataFrame, request_docs: DataFrame, kept_with_text: DataFrame,
            timestamp: str) -> DataFrame:
    """SNK3 / ML14: one answer object (D6) per request; requests whose
    documents are all missing get two empty lists."""
    meta_docs = request_docs.groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("doc_pos", "filename"))), lambda x: x["filename"]).alias("input_documents"))
    secs = kept_with_text.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "importance_rank", "section_title", "page_number", F.col("filename").alias("document"), "refined_text"))).alias("s"))
    out = requests.join(meta_docs, "request_id", "left").join(secs, "request_id", "left")
    s = F.coalesce(F.col("s"), F.array().cast(
        "array<struct<importance_rank:int,section_title:string,page_number:int,document:string,refined_text:string>>"))
    return out.select(
        "request_id",
        F.struct(
            F.coalesce(F.col("input_documents"), F.array().cast("array<string>")).alias("input_documents"),
            F.col("persona").alias("persona"), F.col("task").alias("job_to_be_done"),
            F.lit(timestamp).alias("processing_timestamp"),
        ).alias("metadata"),
        F.transform(s, lambda x: F.struct(
            x["section_title"].alias("section_title"), x["importance_rank"].alias("importance_rank"),
            x["page_number"].alias("page_number"), x["document"].alias("document"))).alias("extracted_sections"),
        F.transform(s, lambda x: F.struct(
            x["document"].alias("document"), x["refined_text"].alias("refined_text"),
            x["page_number"].alias("page_number"))).alias("subsection_analysis"),
    )


# ---- model hook (UD1) -----------------------------------------------------

def prompts(requests: DataFrame, request_docs: DataFrame, docs: DataFrame, headings: DataFrame) -> DataFrame:
    """F8: section-finder prompt per (request, document with content); the
    persona, task and document come from the request, the content is A12."""
    rd = join_outlines(request_docs, docs)
    content = text_content(headings).filter(strip(F.col("content")) != "")
    p = rd.join(content, "doc_id").join(requests, "request_id")
    prompt = F.format_string(
        "You are a %s. Your task is: %s\n\nFind in the document \"%s\" the 1-2 sections most relevant to the task.\n\n"
        "Document content:\n%s\n\nAnswer with a JSON array of objects with section_title, importance_rank, page_number.",
        F.col("persona"), F.col("task"), F.col("filename"), F.col("content"))
    return p.select("request_id", "doc_id", "filename", "doc_pos", prompt.alias("prompt"))


def parse_model_sections(response: Column) -> Column:
    """F5 + P21: the first JSON array in a text (first '[' to first ']'),
    its objects as section records; elements that are no objects are left
    out, a rank or page given as text is read as a number. NULL when there
    is no array or it is no valid JSON."""
    from .. import schemas

    arr = F.regexp_extract(response, r"(?s)\[.*?\]", 0)
    elements = F.when(arr != "", F.from_json(arr, "array<string>"))
    objects = F.filter(elements, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    rows = F.transform(objects, lambda x: F.from_json(x, schemas.MODEL_SECTION))
    return F.transform(rows, lambda r: F.struct(
        r["section_title"].alias("section_title"), r["importance_rank"].try_cast("int").alias("importance_rank"),
        r["page_number"].try_cast("int").alias("page_number")))


def hook_sections(prompt_rows: DataFrame, model_fn, memo_path: str | None = None, **options) -> DataFrame:
    """UD1: run a user batch function (pandas Series of prompts -> Series
    of response texts, None on failure) through the memo table of
    ``generator`` and turn the answers into candidate sections, in the form
    of ``candidate_sections`` (fallback F6 on a missing or invalid answer;
    ``[]`` means no section). Without a ``memo_path`` the memo is this run's own."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from .generator import responses

    memo = memo_path or f"{ensure_checkpoint_dir(prompt_rows.sparkSession).rstrip('/')}/memo-{uuid.uuid4().hex}"
    return parsed_sections(responses(prompt_rows, model_fn, memo, **options).drop("prompt"))


def parsed_sections(responses: DataFrame) -> DataFrame:
    """Candidate sections from (request_id, doc_id, filename, doc_pos, response)."""
    parsed = responses.withColumn("secs", parse_model_sections(F.col("response")))
    parsed = parsed.withColumn("from_model", F.col("secs").isNotNull())
    f = fallback_section(F.col("filename"))
    one = F.array(F.struct(f["section_title"].alias("section_title"), f["importance_rank"].alias("importance_rank"),
                           f["page_number"].alias("page_number")))
    secs = F.coalesce(F.col("secs"), one)
    rows = parsed.select("request_id", "doc_id", "filename", "doc_pos", "from_model", F.posexplode(secs).alias("pos", "s"))
    return rows.select(
        "request_id", "doc_id", "filename", "doc_pos", F.col("s.section_title").alias("section_title"),
        F.col("s.importance_rank").alias("importance_rank"), F.col("s.page_number").alias("page_number"),
        (F.col("pos") + 1).alias("pos_in_doc"),
        *[F.lit(None).cast(t).alias(c) for c, t in zip(SEC_KEY, ["int", "double", "int"])],
        F.lit(True).alias("is_fallback"), "from_model")
