"""Bench: the headline jobs of the engine on one scale factor.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default sf0.1) and prints
one JSON line with the seconds of each job and their sum. Each job is
timed to a materialized result (checkpoint / count), with the stages it
depends on already materialized, so the numbers are per stage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from docstrata.operators import language as L  # noqa: E402
from docstrata.operators import model as M  # noqa: E402
from docstrata.operators import toc as TOC  # noqa: E402
from docstrata.plans.pipeline import Corpus, write_stage  # noqa: E402
from docstrata.session import get_spark  # noqa: E402
from docstrata.sources import fixtures  # noqa: E402
from docstrata.sources.tables import table  # noqa: E402


def timed(fn):
    t = time.time()
    out = fn()
    return out, time.time() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    q: dict[str, float] = {}
    # warm-up: JVM start, first scan
    table(spark, sf_dir, "documents").select("doc_id").count()

    c = Corpus.from_fixtures(spark, sf_dir)
    _, q["blocks_stage1"] = timed(lambda: c.blocks.count())
    _, q["groups_scored_stage2"] = timed(lambda: c.scored.count())
    _, q["titles_outline"] = timed(lambda: write_stage(c.headings).count() + c.titles.count())
    _, q["answers_stage3"] = timed(lambda: c.answers().count())

    def toc_job():
        lines = write_stage(fixtures.fx_toc_lines(spark, sf_dir))
        return TOC.add_toc_flags(c.blocks, lines).filter("in_TOC_flag").count() + TOC.toc_entries(lines).count()

    _, q["toc_flags"] = timed(toc_job)

    def lang_job():
        prof = write_stage(L.fit_profiles(table(spark, sf_dir, "documents")))
        texts = c.blocks.select("doc_id", "page", "block_seq", "text")
        return L.detect_language(texts, prof, ["doc_id", "page", "block_seq"]).groupBy("language").count().collect()

    _, q["language_profiles"] = timed(lang_job)

    # 10 + 10 trees on up to 20,000 rows of a class, and the accuracy over the whole held-out part
    def fit_job():
        model, test = M.fit_structure_model(M.weak_labels(c.scored), title_params=dict(maxIter=10, maxDepth=4),
                                            heading_params=dict(numTrees=10, maxDepth=6), sample_rows=20_000)
        return M.accuracy(model, test).first()

    _, q["model_fit_small"] = timed(fit_job)

    total = sum(q.values())
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()}, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
