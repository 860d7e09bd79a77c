import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from docstrata.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s


def block_rows(spark, rows):
    """Stage-2 block records from (doc_id, page, seq, text, size, bold, y, spacing[, italic, font])."""
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType()),
        T.StructField("block_seq", T.IntegerType()), T.StructField("y0", T.DoubleType()),
        T.StructField("text", T.StringType()), T.StructField("avg_font_size", T.DoubleType()),
        T.StructField("font_name", T.StringType()), T.StructField("is_bold", T.BooleanType()),
        T.StructField("is_italic", T.BooleanType()), T.StructField("is_center_aligned", T.BooleanType()),
        T.StructField("caps_ratio", T.DoubleType()), T.StructField("indentation_ratio", T.DoubleType()),
        T.StructField("y_position_relative", T.DoubleType()), T.StructField("spacing_above", T.DoubleType()),
    ])
    data = []
    for r in rows:
        doc, page, seq, text, size, bold, y, spacing = r[:8]
        italic = r[8] if len(r) > 8 else False
        font = r[9] if len(r) > 9 else "Helvetica"
        data.append((doc, page, seq, float(seq), text, float(size), font, bold, italic, False, 0.0, 0.1,
                     float(y), float(spacing)))
    return spark.createDataFrame(data, schema)
