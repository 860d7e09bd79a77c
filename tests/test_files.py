"""SRC5 / SRC6 block-file scan, SNK1 / SNK2 / SNK5 writers."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from docstrata.sources import sinks, tables

def test_block_file_scan_keeps_order_and_bad_records(spark):
    d = tempfile.mkdtemp(prefix="docstrata-files-")
    blocks = [{"page": 1, "text": f"line {i}", "avg_font_size": 12.0, "font_name": "A", "is_bold": False,
               "is_italic": False, "is_center_aligned": False, "caps_ratio": 0.0, "indentation_ratio": 0.1,
               "y_position_relative": 0.1 * i, "spacing_above": 0.0} for i in range(5)]
    with open(os.path.join(d, "doc one.json"), "w") as f:
        json.dump(blocks, f)
    with open(os.path.join(d, "empty.json"), "w") as f:
        json.dump([], f)
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write("{not json")
    parsed = tables.block_files(tables.json_files(spark, d))
    rows = tables.explode_block_files(parsed).orderBy("block_seq").collect()
    assert [r["doc_key"] for r in rows] == ["doc one"] * 5
    assert [r["text"] for r in rows] == [f"line {i}" for i in range(5)]
    bad = sinks.bad_records(parsed, "structure").collect()
    assert [r["doc_key"] for r in bad] == ["broken"]


def test_writers(spark):
    from docstrata.plans.pipeline import Corpus
    from tests.conftest import SF_SMALL

    c = Corpus.from_fixtures(spark, SF_SMALL, with_requests=False)
    d = tempfile.mkdtemp(prefix="docstrata-sinks-")
    sinks.write_blocks(c.blocks, f"{d}/blocks")
    assert spark.read.parquet(f"{d}/blocks").count() == c.blocks.count()
    sinks.write_outlines(c.outlines, f"{d}/outlines")
    back = spark.read.json(f"{d}/outlines")
    assert back.count() == c.outlines.count()
    assert "outline" in back.columns
