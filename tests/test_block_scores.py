"""Bounds of the block scorers: nothing that belongs to the answer is left out, and few pairs are scored exactly."""

import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askframe.operators import block_scores as B
from askframe.operators.similarity import (build_cells, cell_depths, depth_for_recall, nprobe_for_recall, sampled_questions,
                                           search_cells)


def _cosines(q, d):
    return B.unit_rows(q) @ B.unit_rows(d).T


def _must_have(cos, k, need):
    """Pairs of the answer: at or above the question's limit and not below its k-th best."""
    kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1] if cos.shape[1] >= k else np.full(len(cos), -np.inf)
    return {(i, j) for i, j in zip(*np.nonzero(cos >= np.maximum(need, kth)[:, None] + 1e-8))}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 70), st.integers(1, 7), st.floats(-0.2, 0.9))
def test_quantised_bounds_never_lose_a_pair(seed, nq, nd, dim, k, need):
    rng = np.random.default_rng(seed)
    q, d = rng.normal(size=(nq, dim)) * 10.0 ** rng.integers(-20, 20), rng.normal(size=(nd, dim)) * 10.0 ** rng.integers(-20, 20)
    d[rng.random(nd) < 0.1] = 0.0
    q[rng.random(nq) < 0.1] = 0.0
    d[rng.random(nd) < 0.2] = d[0]
    qi, di = B.quantised_pairs(q, d, k, np.full(nq, need))
    cos = _cosines(q, d)
    assert _must_have(cos, k, np.full(nq, need)) <= set(zip(qi.tolist(), di.tolist()))
    codes, scale, rest = B.quantise(q)
    assert np.allclose(np.sqrt(((B.unit_rows(q) - codes * scale[:, None]) ** 2).sum(axis=1)), rest)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 60), st.integers(1, 50), st.integers(1, 7), st.floats(-0.2, 0.9))
def test_posting_lists_never_lose_a_pair(seed, nq, nd, dim, k, need):
    rng = np.random.default_rng(seed)
    q, d = (np.floor(rng.exponential(0.6, (n, dim)) * rng.integers(1, 5)).astype(float) for n in (nq, nd))
    qn, dn = np.sqrt((q * q).sum(axis=1)), np.sqrt((d * d).sum(axis=1))
    qi, di, dots, _ = B.posting_pairs(q, d, qn, dn, k, np.full(nq, need))
    assert _must_have(_cosines(q, d), k, np.full(nq, need)) <= set(zip(qi.tolist(), di.tolist()))
    assert np.array_equal(dots, (q @ d.T)[qi, di])


def test_dots_in_the_order_of_dimensions():
    rng = np.random.default_rng(2)
    q, d = rng.normal(size=(3, 9)), rng.normal(size=(4, 9))
    qi, di = np.nonzero(np.ones((3, 4)))
    want = []
    for i, j in zip(qi, di):
        s = 0.0
        for a, b in zip(q[i], d[j]):
            s += a * b
        want.append(s)
    assert B.dots_in_order(q, d, qi, di).tolist() == want


def _vectors(spark, x, name="doc_id", kind="double"):
    return spark.createDataFrame([(i, [a.item() for a in v]) for i, v in enumerate(x)], f"{name} long, embedding array<{kind}>")


def test_few_pairs_of_unstructured_vectors_are_scored_exactly(spark):
    x = np.random.default_rng(4).normal(size=(1200, 64))
    docs = _vectors(spark, x)
    stats = {}
    got = search_cells(docs.withColumnRenamed("doc_id", "query_id"), build_cells(docs), stats=stats).collect()
    assert stats["pairs_scored"] == stats["pairs_total"] and 0 < stats["pairs_exact"].value < 0.1 * stats["pairs_total"]
    cos = _cosines(x, x)
    for i in range(0, 1200, 100):
        want = [j for j in np.argsort(-cos[i], kind="stable")[:5] if cos[i, j] >= 0.25]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_few_pairs_of_counts_are_scored_exactly(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.exponential(1.0, (800, 40)) * (rng.random((800, 40)) < 0.5)).astype(int)
    docs = _vectors(spark, x, kind="int")
    stats = {}
    q = docs.where("doc_id < 100").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): r.raw_score for r in search_cells(q, build_cells(docs, integer=True, cell_rows=200), stats=stats).collect()}
    cos = np.sort(_cosines(x.astype(float), x.astype(float)), axis=1)[:, ::-1]
    assert all(abs(got[i, r] - cos[i, r - 1]) < 1e-12 for i in range(100) for r in range(1, 6) if cos[i, 0] > 0)
    assert 0 < stats["pairs_exact"].value < 0.1 * stats["pairs_total"] and stats["pairs_touched"].value > 0


def test_negative_whole_numbers_are_scored_like_real_vectors(spark):
    x = np.random.default_rng(6).integers(-3, 4, (120, 10))
    docs = _vectors(spark, x, kind="int")
    got = search_cells(docs.withColumnRenamed("doc_id", "query_id"), build_cells(docs, integer=True), k=1, threshold=0.0).collect()
    assert all(abs(r.raw_score - 1.0) < 1e-12 for r in got) and len(got) == 120


@pytest.mark.parametrize("depths,recall,want", [({}, 0.9, 1), ({1: [1, 1]}, 0.9, 1), ({1: [1], 2: [3], 3: [2]}, 0.99, 3)])
def test_depth_of_small_samples(depths, recall, want):
    assert depth_for_recall(depths, recall, 0.95) == want


def test_lower_bound_counts_the_answers_of_a_question_together():
    together = {i: [9] * 5 if i < 16 else [1] * 5 for i in range(200)}      # 92 %, questions found whole or not at all
    apart = {i: [9 if i < 80 else 1, 1, 1, 1, 1] for i in range(200)}        # 92 %, one answer missed in 80 questions
    assert depth_for_recall(together, 0.9, 0.95) == 9 and depth_for_recall(apart, 0.9, 0.95) == 1


def test_nprobe_searches_only_a_sample_exactly(spark, monkeypatch):
    import askframe.operators.similarity as S
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    docs = _vectors(spark, x)
    q = docs.withColumnRenamed("doc_id", "query_id")
    index = build_cells(docs, cell_rows=60)
    asked = []
    original = S.search_cells
    monkeypatch.setattr(S, "search_cells", lambda questions, *a, **k: asked.append(questions.count()) or original(questions, *a, **k))
    nprobe = nprobe_for_recall(q, index, recall=0.9, sample=100)
    assert asked == [100] and 1 <= nprobe < 25
    few = sampled_questions(q, "query_id", 100)
    assert cell_depths(few, index, qid="query_id", vec="embedding", k=5, threshold=0.25).count() <= 500  # one row per answer
    others = q.join(few.select("query_id"), "query_id", "left_anti")
    exact = {(r.query_id, r.doc_id) for r in original(others, index).collect()}
    found = {(r.query_id, r.doc_id) for r in original(others, index, mode="approx", nprobe=nprobe).collect()}
    assert len(exact & found) / len(exact) >= 0.9


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 60), st.integers(1, 70), st.integers(1, 7), st.floats(-0.2, 0.9),
       st.floats(0, 1))
def test_products_never_lose_a_pair_and_meet_only_visited_parts(seed, nq, nd, dim, k, need, share):
    rng = np.random.default_rng(seed)
    q, d = rng.normal(size=(nq, dim)) * 10.0 ** rng.integers(-20, 20), rng.normal(size=(nd, dim))
    d[rng.random(nd) < 0.1] = 0.0
    if nd:
        d[rng.random(nd) < 0.3] = d[0]
    part = np.sort(rng.integers(0, 5, nd))
    start, visits = np.searchsorted(part, np.arange(6)), rng.random((nq, 5)) < share
    pairs = list(B.product_pairs(B.unit_rows(q).astype(np.float32), B.unit_rows(d).astype(np.float32), k, np.full(nq, need), visits, start))
    got = [(i, j) for rows, cols in pairs for i, j in zip(rows.tolist(), cols.tolist())]
    cos = np.where(visits[:, part], _cosines(q, d), -np.inf)
    assert len(got) == len(set(got)) and all(visits[i, part[j]] for i, j in got)
    assert _must_have(cos, k, np.full(nq, need)) <= set(got)


@pytest.mark.parametrize("v", [np.array([1, -128]), np.array([300, 0]), np.array([1 << 40, 2]), np.array([0.1, np.nan], np.float32),
                               np.array([0.1, 1e300]), np.zeros(0)])
def test_packed_vectors_come_back(v):
    assert np.array_equal(B.unpack([B.pack(v)])[0], v.astype(float), equal_nan=True)
    assert len(B.pack(np.ones(384, np.int32))) < 400  # counts travel as single bytes


def test_a_question_travels_once_per_group_of_cells():
    import askframe.operators.similarity as S
    groups, group_of, place = S._cell_groups(np.array([5, 5, 30, 0, 8, 3]), 12)
    assert [g.tolist() for g in groups] == [[0, 1], [2], [3, 4, 5]]
    assert group_of.tolist() == [0, 0, 1, 2, 2, 2] and place.tolist() == [0, 1, 0, 0, 1, 2]


def _of_a_block(packed, questions, k=5, need=0.3):
    q, d = B.unpack(packed[:questions]), B.unpack(packed)
    ask = np.full(questions, need)
    pairs = list(B.product_pairs(B.unit_float32(q), B.unit_float32(d), k, ask, np.ones((questions, 1), dtype=bool), np.array([0, len(d)])))
    rows, cols = (np.concatenate(x) for x in zip(*pairs))
    return rows, cols, B.dots_in_order(q, d, rows, cols)


def test_a_block_of_counts_takes_less_memory_than_its_numbers_in_float64():
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.random(384) ** 3 * 3, size=(12_000, 384)).astype(np.int32)
    packed = [B.pack(v) for v in counts]
    tracemalloc.start()
    rows, cols, dots = _of_a_block(packed, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < counts.size * 8 * 1.5, f"{peak / 1e6:.0f} MB"
    assert len(rows) >= 200 * 5 and np.array_equal(dots, (counts[rows].astype(np.int64) * counts[cols]).sum(axis=1))


@pytest.mark.parametrize("kinds", [(np.int32, np.int32), (np.int64, np.int32), (np.float32, np.float64), (np.float32, np.float32)])
def test_dots_of_packed_vectors_are_those_in_float64(kinds):
    rng = np.random.default_rng(8)
    q, d = ((rng.standard_normal((6, 20)) * 300).astype(kind) for kind in kinds)
    d[:3] = d[:3] / 100  # vectors of one block packed in different types
    qi, di = (x.ravel() for x in np.indices((6, 6)))
    got = B.dots_in_order(B.unpack([B.pack(v) for v in q]), B.unpack([B.pack(v) for v in d]), qi, di)
    assert np.array_equal(got, B.dots_in_order(q.astype(np.float64), d.astype(np.float64), qi, di))
    assert np.array_equal(B.unit_float32(q), B.unit_rows(q.astype(np.float64)).astype(np.float32))


def test_documents_are_held_and_questions_pass_by():
    rng = np.random.default_rng(12)
    d = rng.poisson(0.4, size=(5000, 30)).astype(np.int32)
    d[100:200] = d[0]
    docs = B.Documents(3)
    packed = [B.pack(v) for v in d]
    for at in range(0, 5000, 700):  # one part, as batches bring it
        docs.add(packed[at:at + 700], np.zeros(len(packed[at:at + 700]), dtype=int), at)
    q = d[:300]
    rows, cols, dots = docs.pairs(q, 3, np.full(300, 0.2), np.ones((300, 1), dtype=bool))
    assert docs.size == np.minimum(np.unique(d, axis=0, return_counts=True)[1], 3).sum()  # of equal vectors k are held
    assert np.array_equal(dots, (q[rows] * d[cols]).sum(axis=1))
    cos = _cosines(q.astype(float), d.astype(float))
    for i in range(300):
        got = np.sort(cos[i, cols[rows == i]])[::-1]
        want = np.sort(cos[i][cos[i] >= 0.2])[::-1][:3]
        assert len(got) >= len(want) and np.allclose(got[:len(want)], want) and len(got) < 60


def test_what_travels_to_the_blocks_of_a_search_stays_small():
    import askframe.operators.similarity as S
    documents, questions = 2_500_000, 2_500_000
    rows = S.BLOCK_BYTES // 384
    held = {g: rows for g in range(math.ceil(documents / rows))}
    blocks = S._blocks(held, dict.fromkeys(held, questions), rows, 48)
    moved = sum(held[g] * qn + questions * dn for g, (dn, qn) in blocks.items())
    assert moved < 40 * (documents + questions)  # 153 times both sides in square blocks of 16,384
    assert len(held) * 10 >= 48 and S._blocks({0: 100}, {0: 50}, rows, 48) == {0: (1, 1)}
    assert S._blocks({0: 4000}, {0: 10 ** 6}, rows, 48)[0][1] == 48


def test_the_second_phase_leaves_out_the_cell_that_the_first_visited(spark):
    import askframe.operators.similarity as S
    x = np.repeat(np.eye(2), 6, axis=0) + 0.01 * np.random.default_rng(3).random((12, 2))
    index = build_cells(_vectors(spark, x), cell_rows=6)
    assert len(index.centroids) == 2
    cell = {r["_did"]: r["_cell"] for r in index.assigned.collect()}
    q = spark.createDataFrame([(i, [1.0, 1.0], i) for i in (0, 1)], "_qid long, _v array<double>, _near int")  # as near to both cells
    find = dict(k=20, threshold=0.1, block_rows=None, stats=None)
    first = {(r["_qid"], cell[r["_did"]]) for r in S._search(q, index, nearest=1, **find).collect()}
    second = {(r["_qid"], cell[r["_did"]]) for r in
              S._search(q.withColumn("_floor", F.lit(None).cast("double")), index, nearest=None, **find).collect()}
    assert first == {(0, 0), (1, 1)} and second == {(0, 1), (1, 0)}
