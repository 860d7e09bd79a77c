"""The block stage makes the spans of derived inputs once, and reads them once for a document's statistics."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docstrata import schemas
from docstrata.functions import counts as C
from docstrata.functions import fonts
from docstrata.operators import blocks as B
from docstrata.plans.pipeline import Corpus


def _spans(spark, path):
    rng = random.Random(5)
    names = ["Helvetica-Bold", "Times-Italic", "Arial-Black", "Helvetica-LightOblique", "Courier", None]
    rows = [(d, p, b, 0, s, rng.choice(["a b", "word", " "]), rng.choice(names), rng.choice([9.0, 11.0, 11.5, None]),
             rng.choice([0, 2, 8, 16, 32, 48, None]), 0, 0.0, float(b), 10.0, b + 1.0, 612.0, 792.0)
            for d in range(6) for p in (1, 2) for b in range(5) for s in range(3)]
    spark.createDataFrame(rows, schemas.SPANS).write.parquet(path)
    return spark.read.parquet(path)


def test_derived_spans_are_made_once(spark, tmp_path):
    docs = pa.table({"doc_id": pa.array([1, 2]), "text": ["Title\nbody, with spans", None], "lang": ["en", "en"]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    c = Corpus.from_fixtures(spark, str(tmp_path), with_requests=False)
    files = c.spans.inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    assert c.spans is c.spans
    assert [r.doc_id for r in c.docs.orderBy("doc_id").collect()] == [1]


def test_statistics_read_the_spans_once(spark, tmp_path):
    path = str(tmp_path / "spans")
    spans = _spans(spark, path)
    stats = B.span_doc_stats(spans)
    assert not any(path in f for f in stats.inputFiles())  # all from the written table of fonts and sizes
    got = {r.doc_id: (r.median_font_size, r.dominant_font) for r in stats.collect()}
    rows = spans.collect()
    for d in range(6):
        mine = [r for r in rows if r.doc_id == d]
        first = {}
        for r in sorted(mine, key=lambda r: (r.page, r.block_seq, r.line_seq, r.span_seq)):
            n, at = first.get(r.font, (0, len(first)))
            first[r.font] = (n + 1, at)
        font = min(first, key=lambda f: (-first[f][0], first[f][1]))
        assert got[d] == (float(np.median([r.size for r in mine if r.size is not None])), font)


def test_style_flags_of_a_block_are_those_of_any_span(spark, tmp_path):
    spans = _spans(spark, str(tmp_path / "spans"))
    styles = fonts.font_styles(F.col("font"), F.col("flags"))
    want = spans.groupBy("doc_id", "page", "block_seq").agg(
        *[F.bool_or(styles[c]).alias(c) for c in schemas.STYLE_COLUMNS],
        F.bool_or(fonts.bit(F.col("flags"), fonts.FLAG_STRIKE)).alias("is_strikethrough"))
    got = B.assemble_blocks(spans).select(*want.columns)
    assert got.count() > 40
    assert got.exceptAll(want).isEmpty()


def test_classes_by_byte_are_those_by_code_point():
    below = "".join(map(chr, range(0x100)))
    assert (C._classes(below) == C._classes(below + " ")[:-1]).all()
    assert C._classes(below).dtype == np.uint8 and C._classes("\ud800")[0] == C.ODD
