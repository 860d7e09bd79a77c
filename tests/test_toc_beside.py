"""J3 inside the block stage: entries of a document beside its blocks, spans moved once."""

import difflib
import random

from pyspark.sql import functions as F

from docstrata import schemas
from docstrata.operators import blocks as B
from docstrata.operators import toc as TOC


def _spans(spark, docs=6, seed=5):
    rng = random.Random(seed)
    words = ["state", "notes", "oasis", "late", "tone", "plan", "élan", "x"]
    rows, lines = [], []
    for d in [*range(docs), None]:
        for page in [*range(1, 6), None]:
            for seq in range(rng.randrange(1, 6)):
                at = (page or 0) * 10 + seq
                text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))
                rows.append((d, page, at, 0, 0, text, "Helvetica", 11.0, 0, 0, 72.0, 40.0 + 60 * seq, 540.0, 80.0 + 60 * seq, 612.0, 792.0))
                if rng.random() < 0.5:
                    entry = text if rng.random() < 0.5 else text.replace("e", "", 1)
                    lines.append((d, rng.choice([1, 2, 3, 4, None]), at, f"{entry} ..... 3"))
    return spark.createDataFrame(rows, schemas.SPANS), spark.createDataFrame(lines * 2, "doc_id long, page int, line_no int, line string")


def test_flags_of_the_block_stage_are_the_close_matches(spark):
    spans, lines = _spans(spark)
    blocks = B.blocks_from_spans(spans, toc_lines=lines)
    got = blocks.select("doc_id", "page", "block_seq", "text", "in_TOC_flag").collect()
    assert blocks.columns == B.blocks_from_spans(spans).columns
    entries = {}
    for r in TOC.toc_entries(lines).collect():
        entries.setdefault(r.doc_id, []).append(r.entry)
    n = 0
    for r in got:
        near = difflib.get_close_matches(r.text.strip(), entries.get(r.doc_id, []), n=1, cutoff=0.85)
        assert r.in_TOC_flag == (bool(near) and r.doc_id is not None and r.page is not None), r
        n += r.in_TOC_flag
    assert 0 < n < len(got)
    joined = TOC.add_toc_flags(B.blocks_from_spans(spans), lines).select("doc_id", "page", "block_seq", "in_TOC_flag")
    assert {tuple(r) for r in joined.collect()} == {(r.doc_id, r.page, r.block_seq, r.in_TOC_flag) for r in got}


def test_spans_and_texts_move_once(spark):
    """The flags were joined from three copies of the block plan."""
    spans, lines = _spans(spark)
    plan = B.blocks_from_spans(spans, toc_lines=lines)._jdf.queryExecution().executedPlan().toString()
    with_text = [x for x in plan.splitlines() if "collect_list(struct(line_seq" in x and "partial_collect_list" not in x]
    assert len(with_text) == 1, plan


def test_stages_of_texts_are_compact(spark):
    from docstrata.plans.pipeline import TEXT_CODEC, Corpus

    spans, _ = _spans(spark)
    c = Corpus(spans, derived=True)
    for df in (c.spans, c.blocks):
        assert all(TEXT_CODEC in f for f in df.inputFiles())
    assert c.blocks.filter(F.col("in_TOC_flag")).isEmpty()
