"""Hot keys: one key, sheet or cell holding a third (or more) of all rows."""

import numpy as np
from pyspark.sql import functions as F

from askframe.operators import kb as K
from askframe.operators.pairing import pair_questions
from askframe.operators.similarity import similarity_topk


def test_dedup_hot_key_partial_aggregation(spark):
    n = 3000
    df = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("key"),
        F.col("id").alias("pos"), F.col("id").cast("string").alias("payload"))
    out = K.dedup_keep_first(df.repartition(12), "key", ["pos"])
    got = {r.key: r.pos for r in out.collect()}
    assert got["HOT"] == 0 and len(got) == 1 + (n - n // 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan          # hot key folded map-side before the shuffle


def test_pairing_hot_sheet(spark):
    big = spark.range(0, 2000).select(F.lit("HOT").alias("sheet"), F.col("id").alias("row_no"))
    small = spark.range(0, 30).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("sheet"),
                                      F.col("id").alias("row_no"))
    rows = big.unionByName(small).select(
        "sheet", "row_no",
        F.when(F.col("row_no") % 5 == 1, F.concat(F.lit("q"), F.col("row_no").cast("string"), F.lit("?")))
         .otherwise(F.concat(F.lit("l"), F.col("row_no").cast("string"))).alias("text"),
        F.lit("P").alias("product")).withColumn("is_q", F.col("text").endswith("?"))
    a = sorted(tuple(r) for r in pair_questions(rows, ["sheet"], block_rows=1 << 30).collect())
    b = sorted(tuple(r) for r in pair_questions(rows, ["sheet"], block_rows=16).collect())
    assert a == b and len([r for r in a if r[0] == "HOT"]) == 1 + 2000 // 5


def test_similarity_hot_cell_and_hot_queries(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    hot = base + 0.05 * rng.normal(size=(200, 8))          # 200 near-identical documents
    other = rng.normal(size=(100, 8))
    d = np.vstack([hot, other]).astype(np.float32)
    q = np.vstack([base + 0.05 * rng.normal(size=(60, 8)), rng.normal(size=(10, 8))]).astype(np.float32)
    qdf = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    ddf = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(d)], "doc_id long, embedding array<float>")
    small = {tuple(r) for r in similarity_topk(qdf, ddf, k=3, cell_rows=50, block_rows=16)
             .select("query_id", "doc_id", "rank", "raw_score").collect()}
    whole = {tuple(r) for r in similarity_topk(qdf, ddf, k=3, cell_rows=10 ** 6, block_rows=10 ** 6)
             .select("query_id", "doc_id", "rank", "raw_score").collect()}
    assert small == whole and len(whole) == 3 * len(q)      # every query finds 3 documents
