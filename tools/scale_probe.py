"""Scaling of the top-k search on enlarged inputs derived from the given ``embeddings`` table.

Documents = the table repeated ``m`` times with a small seeded perturbation
(Spark-side, so the input grows with the data); questions = the original
vectors.  Prints one JSON line per size: wall seconds for exact and approximate
search, the share of question-document pairs actually scored, and the
approximate recall against exact.

usage: python tools/scale_probe.py [sf_dir] [multipliers, e.g. 1,10,50]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from askframe.operators.similarity import build_cells, search_cells  # noqa: E402
from askframe.plans.tables import table  # noqa: E402
from askframe.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    mults = [int(x) for x in (sys.argv[2] if len(sys.argv) > 2 else "1,10,50").split(",")]
    spark = build_session("local[8]", shuffle_partitions=16)
    emb = table(spark, sf, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    for m in mults:
        docs = (emb.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
                   .select((F.col("copy") * 1_000_000 + F.col("vec_id")).alias("doc_id"),
                           F.transform("embedding", lambda x, i: (x + F.when(F.col("copy") > 0, 0.05 * (
                               F.rand(7) - 0.5)).otherwise(0.0)).cast("float")).alias("embedding")))
        docs = docs.checkpoint(eager=True)
        out = {"multiplier": m, "docs": docs.count(), "queries": queries.count()}
        t0 = time.time()
        cells = build_cells(docs, cell_rows=256)
        out["cells_build_s"] = round(time.time() - t0, 2)
        for mode in ("exact", "approx"):
            st: dict = {}
            t0 = time.time()
            hits = search_cells(queries, cells, mode=mode, nprobe=4, stats=st).select("query_id", "doc_id")
            rows = {tuple(r) for r in hits.collect()}
            out[f"{mode}_s"] = round(time.time() - t0, 2)
            out[f"{mode}_scored_share"] = round(st["pairs_scored"] / st["pairs_total"], 4)
            out[f"{mode}_hits"] = len(rows)
            out[f"{mode}_rows"] = rows
        exact, approx = out.pop("exact_rows"), out.pop("approx_rows")
        out["approx_recall"] = round(len(exact & approx) / max(1, len(exact)), 4)
        print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
