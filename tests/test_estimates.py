"""Sampled hit rates with intervals, and length profiles merged from summaries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.operators import evaluate as EV
from askframe.operators import profile_sketch as P
from askframe.operators import sft as S


def _lengths(spark, values, name="instruction"):
    return spark.createDataFrame([(i, "x" * v, "y" * (v % 7)) for i, v in enumerate(values)], f"id long, {name} string, response string")


@pytest.mark.parametrize("points", [20, 200])
def test_merged_quantiles_are_within_the_stated_rank_error(spark, points):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 40, 900), rng.integers(500, 900, 300), np.full(800, 77)]).tolist()
    random.Random(2).shuffle(values)
    rows = _lengths(spark, values).withColumn("batch", F.col("id") % 7)
    merged = {r.field: r for r in P.merge_summaries(P.length_summary(rows, by="batch", points=points)).collect()}
    got, order = merged["instruction_len"], np.sort(values)
    exact = {r.field: r for r in S.length_profile(rows).collect()}["instruction_len"]
    assert (got.n, got.mean, got.std, got.min, got["max"]) == (exact.n, exact.mean, exact.std, exact.min, exact["max"])
    assert got.rank_error == round(1 / (2 * points) + 7 / len(values), 6)
    for q in (25, 50, 75):
        v, n = got[f"p{q}"], len(order)
        low, high = np.searchsorted(order, v, "left") / n, np.searchsorted(order, v, "right") / n
        assert low - got.rank_error <= q / 100 <= high + got.rank_error


def test_merging_stored_summaries_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    rows = _lengths(spark, [rng.randint(0, 300) for _ in range(600)]).withColumn("batch", F.col("id") % 5)
    path = str(tmp_path / "s")
    for b in range(5):  # appended one by one, each reading its own rows only
        P.length_summary(rows.filter(F.col("batch") == b).repartition(1 + b)).write.parquet(f"{path}/batch={b}")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(P.merge_summaries(spark.read.parquet(path))) == key(P.merge_summaries(P.length_summary(rows.repartition(9), by="batch")))


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "id long, instruction string, response string")
    assert P.length_summary(none).collect() == [] and P.merge_summaries(P.length_summary(none)).collect() == []
    one = P.merge_summaries(P.length_summary(spark.createDataFrame([(1, "abc", None)], none.schema))).collect()
    assert [(r.field, r.n, r.mean, r.std, r.p50) for r in one] == [("instruction_len", 1, 3.0, None, 3.0)]


def _fake_search(monkeypatch, first):
    """First-hit ranks without a search: ``first(n)`` of the number in the id."""
    asked = []

    def ranks(gold, kb_vectors, k, **search):
        asked.append(gold.count())
        return gold.select("query_id", first(F.substring("query_id", 5, 9).cast("long")).cast("int").alias("first_hit"))

    monkeypatch.setattr(EV, "first_hit_ranks", ranks)
    return asked


def _kb(spark, n):
    return spark.range(n).select(F.concat(F.lit("doc_"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
                                 F.when(F.col("id") < 7, "small").otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("category"),
                                 F.lit("q").alias("question"), F.lit("a").alias("answer"), F.col("id").alias("ord"))


def test_interval_holds_the_exact_rate_and_few_questions_are_searched(spark, monkeypatch):
    first = lambda i: F.when(i % 10 < 6, 1).when(i % 10 < 8, 3)  # noqa: E731 - exact rates 0.6 and 0.8
    asked = _fake_search(monkeypatch, first)
    rows = {r.top_k: r for r in EV.estimated_hit_rates(_kb(spark, 6000), None, [1, 3], rate=0.1, least=20).collect()}
    assert asked[0] < 800 and rows[1].n_sampled == asked[0]
    assert rows[3].top1_low <= 0.6 <= rows[3].top1_high and rows[3].topk_low <= 0.8 <= rows[3].topk_high
    assert rows[3].topk_high - rows[3].topk_low < 0.12 and rows[1].topk_match == rows[1].top1_match


def test_small_strata_are_taken_whole(spark, monkeypatch):
    asked = _fake_search(monkeypatch, lambda i: F.when(i < 7, 1))
    gold = EV.sampled_gold(_kb(spark, 3000), 0.05, 20)
    assert gold.filter("stratum = 'small'").count() == 7 and gold.filter("stratum = 'small'").agg(F.min("rate")).first()[0] == 1.0
    exact = EV.estimated_hit_rates(_kb(spark, 15), None, [1], rate=0.01, least=20).first()  # all strata whole: exact, no width
    assert asked == [15] and exact.top1_match == exact.top1_low == exact.top1_high == round(7 / 15, 4)


def test_no_questions(spark, monkeypatch):
    _fake_search(monkeypatch, lambda i: F.lit(1))
    row = EV.estimated_hit_rates(_kb(spark, 10).filter("ord < 0"), None, [1]).first()
    assert (row.n_sampled, row.top1_match, row.top1_low, row.top1_high) == (0, 0.0, 0.0, 0.0)


def test_recall_counts_the_answers_of_all_questions(spark, tmp_path):
    import numpy as np
    from askframe.plans.catalog_vectors import vec_ann_recall, vec_topk
    x = np.random.default_rng(3).normal(size=(300, 8))  # more rows than the sample that the number of cells is chosen from
    spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    row = vec_ann_recall(spark, str(tmp_path)).first()
    assert row.n_exact == vec_topk(spark, str(tmp_path)).count() and row.n_found >= 0.9 * row.n_exact
