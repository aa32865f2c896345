"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the graph of nearest neighbours, a balanced partitioning
of that graph (recursive spectral bisection, then swaps that lower the cut),
and a small neural classifier that learns which partitions hold a vector's
neighbours.  Every row goes to its most probable partition; a query goes to
its several most probable ones, whose rows are ranked by exact cosine.  How
many partitions a query visits is measured on the sample against brute force,
so that a stated recall is met; on vectors without structure that can be
nearly all of them.  A query whose partitions hold too few rows visits all.

On Spark: partitions are cut into blocks of bounded size, queries too, and a
block meets a block in one co-group that returns a few rows per query.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components take no part, nor do rows
without an id; a repeated vec_id
is one candidate, with its best score; ties go to the smaller vec_id; a query
without candidates has no rows; an empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from askframe.llm import common

SAMPLE_ROWS = 20_000     # vectors that the index is fitted on
NEIGHBOURS = 10
PARTITION_ROWS = 2_500   # wanted rows per partition
LEAST_PARTITIONS, MAX_PARTITIONS = 8, 256
SAMPLE_PER_PARTITION = 20  # sampled vectors a partition needs: only samples under 40 rows leave one partition
PROBES = 1000            # sampled vectors, a tenth of the sample at most, held out of the fit
RECALL = 0.97            # of the probes' true neighbours in the sample, within the partitions visited
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def usable(length: int | None = None) -> Column:
    v = F.col("embedding")
    x_bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, x_bad) & F.exists(v, lambda x: x != 0)
    return ok if length is None else ok & (F.size(v) == length)


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Rows x length in float64, from a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, length)


def unit(X: np.ndarray) -> np.ndarray:
    X = X / np.maximum(np.abs(X).max(axis=1, keepdims=True), 1e-300)
    return X / np.sqrt((X * X).sum(axis=1, keepdims=True))


def neighbour_graph(X: np.ndarray, k: int) -> np.ndarray:
    """Rows x k: the most similar other rows of unit vectors, by blocks."""
    k = min(k, len(X) - 1)
    X = X.astype(np.float32)
    out = np.empty((len(X), k), dtype=np.int64)
    for at in range(0, len(X), 512):
        s = X[at:at + 512] @ X.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(n: int, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Two halves of equal size (0 and 1) of a graph with edges a-b, few edges between them."""
    degree = np.maximum(1.0, np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
    root = np.sqrt(degree)
    x = np.random.default_rng(seed).normal(size=n)
    for _ in range(40):  # power iteration for the second eigenvector of the normalised adjacency
        x -= root * (x @ root) / (root @ root)
        y = x / root
        z = (np.bincount(a, weights=y[b], minlength=n) + np.bincount(b, weights=y[a], minlength=n)) / root
        x = 0.5 * (x + z)
        x /= max(1e-300, np.sqrt(x @ x))
    side = np.zeros(n, dtype=np.int64)
    side[np.argsort(x / root, kind="stable")[n // 2:]] = 1
    cut = int((side[a] != side[b]).sum())
    for _ in range(12):  # swaps of equal numbers keep the balance
        across = side[a] != side[b]
        gain = np.bincount(a, weights=2.0 * across - 1, minlength=n) + np.bincount(b, weights=2.0 * across - 1, minlength=n)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, n // 20))
        m = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not m:
            break
        tried = side.copy()
        tried[left[:m]], tried[right[:m]] = 1, 0
        now = int((tried[a] != tried[b]).sum())
        if now >= cut:
            break
        side, cut = tried, now
    return side


def balanced_partitions(near: np.ndarray, parts: int) -> np.ndarray:
    """A partition number for each node of a neighbour graph; sizes differ by a few nodes. ``parts`` is a power of 2."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    label = np.zeros(n, dtype=np.int64)
    width = 1
    while width < parts:
        nxt = np.empty_like(label)
        for p in range(width):
            nodes = np.flatnonzero(label == p)
            to = np.full(n, -1)
            to[nodes] = np.arange(len(nodes))
            inside = (to[a] >= 0) & (to[b] >= 0)
            nxt[nodes] = 2 * p + bisect(len(nodes), to[a[inside]], to[b[inside]], seed=width + p)
        label, width = nxt, 2 * width
    return label


@dataclass
class Router:
    """A network with one hidden layer: unit vector -> probability of each partition."""

    A: np.ndarray
    a: np.ndarray
    B: np.ndarray
    b: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b)

    @property
    def length(self) -> int:
        return len(self.A)

    def scores(self, X: np.ndarray) -> np.ndarray:
        return np.maximum(X @ self.A + self.a, 0) @ self.B + self.b

    def ranked(self, X: np.ndarray, m: int) -> np.ndarray:
        """The m most probable partitions of each row, most probable first."""
        s = self.scores(unit(X))
        return np.argsort(-s, axis=1, kind="stable")[:, :m]

    @staticmethod
    def fit(X: np.ndarray, wanted: np.ndarray, hidden: int = 96, epochs: int = 12, batch: int = 256, rate: float = 3e-3) -> Router:
        """Cross entropy against ``wanted`` (rows x partitions, each row adding up to 1), by Adam."""
        draw = np.random.default_rng(5)
        d, parts = X.shape[1], wanted.shape[1]
        P = [draw.normal(0, 1.5, (d, hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P], 0
        for e in range(epochs):
            order = draw.permutation(len(X))
            for at in range(0, len(X), batch):
                x, y = X[order[at:at + batch]], wanted[order[at:at + batch]]
                h = np.maximum(x @ P[0] + P[1], 0)
                z = h @ P[2] + P[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                r = (z / z.sum(axis=1, keepdims=True) - y) / len(x)
                back = (r @ P[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x.T @ back, back.sum(0), h.T @ r, r.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    step = rate * (1 - e / (epochs + 1))
                    P[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return Router(*P)


def fit_index(X: np.ndarray, n_rows: int, k: int) -> tuple[Router, int]:
    """A router for ``n_rows`` rows from sample ``X``, and how many partitions a query visits for ``RECALL``.

    The recall is that of probes: sampled vectors which neither the graph nor
    the router has seen, against their true neighbours among the others.
    """
    d = X.shape[1]
    parts = 2 ** round(math.log2(min(MAX_PARTITIONS, max(LEAST_PARTITIONS, n_rows / PARTITION_ROWS))))
    order = np.random.default_rng(9).permutation(len(X))
    held = min(PROBES, len(X) // 10)
    probes, rest = order[:held], np.sort(order[held:])
    while parts > 1 and len(rest) < SAMPLE_PER_PARTITION * parts:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    U = unit(X)
    Q, U = U[probes], U[rest]
    near = neighbour_graph(U, NEIGHBOURS)
    label = balanced_partitions(near, parts)
    wanted = np.zeros((len(U), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(U)), near.shape[1]), label[near].ravel()), 0.5 / near.shape[1])
    wanted[np.arange(len(U)), label] += 0.5
    router = Router.fit(U, wanted)
    own = router.scores(U).argmax(axis=1)
    place = np.argsort(np.argsort(-router.scores(Q), axis=1, kind="stable"), axis=1)  # rank of each partition for each probe
    depth = np.take_along_axis(place, own[_closest(Q, U, min(k, len(U)))], axis=1)
    visited = next(m for m in range(1, parts + 1) if (depth < m).mean() >= RECALL)
    return router, visited


def _closest(Q: np.ndarray, U: np.ndarray, k: int) -> np.ndarray:
    """The k rows of U closest to each row of Q, by blocks."""
    out = np.empty((len(Q), k), dtype=np.int64)
    for at in range(0, len(Q), 512):
        out[at:at + 512] = np.argpartition(-(Q[at:at + 512] @ U.T), k - 1, axis=1)[:, :k]
    return out


def best_of(Q: np.ndarray, q_ids: np.ndarray, D: np.ndarray, d_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row id, cosine) of the k best rows of D for each row of Q, a row of the query's own id left out.

    A matrix product finds the rows within 1e-9 of the k-th best; their cosines
    are then taken row by row, so that equal vectors have equal scores.
    """
    _, which = np.unique(D, axis=0, return_inverse=True)
    order = np.lexsort((d_ids, which.ravel()))
    w, i = which.ravel()[order], d_ids[order]
    fresh = np.append(True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]))  # the same row again
    order, w = order[fresh], w[fresh]
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    order = order[place <= k]  # of equal vectors only the k + 1 smallest ids can matter
    D, d_ids = D[order], d_ids[order]
    S = unit(Q) @ unit(D).T
    S[q_ids[:, None] == d_ids[None, :]] = -np.inf
    least = min(k, S.shape[1])
    floor = -np.partition(-S, least - 1, axis=1)[:, least - 1] - 1e-9
    qi, di = np.nonzero((S >= floor[:, None]) & np.isfinite(S))
    score = np.empty(len(qi))
    nq, nd = np.sqrt((Q * Q).sum(axis=1)), np.sqrt((D * D).sum(axis=1))
    for at in range(0, len(qi), 50_000):
        a, b = qi[at:at + 50_000], di[at:at + 50_000]
        score[at:at + 50_000] = (Q[a] * D[b]).sum(axis=1) / (nq[a] * nd[b])
    order = np.lexsort((d_ids[di], -score, qi))
    qi, di, score = qi[order], di[order], score[order]
    first = np.flatnonzero(np.append(True, qi[1:] != qi[:-1])) if len(qi) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    kept = rank < k
    return q_ids[qi[kept]], d_ids[di[kept]], score[kept]


def search(rows: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest ``rows`` found for each of ``queries`` (both vec_id, embedding)."""
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    picked = given.where(usable() & (common.uniform(F.col("vec_id"), "index sample") < sample_rows / max(1, n)))
    # one vector per id, folded per task: an id with any number of rows is one row of the sample
    one_each = picked.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    sample = one_each.orderBy("vec_id").toPandas()
    lengths = sample["embedding"].map(len)
    if not len(sample):  # a small table may have no row in the sample
        one = given.where(usable()).orderBy("vec_id").limit(1).collect()
        length = len(one[0]["embedding"]) if one else 1
        X = np.zeros((0, length))
    else:
        length = int(lengths.mode().iloc[0])
        X = np.asarray(sample["embedding"][lengths == length].tolist(), dtype=np.float64)
    router, visited = fit_index(X, n, k)

    def assign(batches):
        for batch in batches:
            M = matrix(batch.column("embedding"), length)
            part = router.ranked(M, 1)[:, 0] if len(M) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", *batch.schema.names])

    def route(batches):
        for batch in batches:
            M = matrix(batch.column("embedding"), length)
            to = router.ranked(M, visited) if len(M) else np.empty((0, visited), dtype=np.int64)
            again = pa.array(np.repeat(np.arange(len(M)), visited))
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), *(c.take(again) for c in batch.columns)],
                                             ["part", *batch.schema.names])

    schema = "part int, vec_id bigint, embedding array<double>"
    index = common.written(given.where(usable(length)).mapInArrow(assign, schema), "ann-index")
    asked = (queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
             .where(usable(length)))
    routed = common.written(asked.mapInArrow(route, schema), "ann-queries")
    best = _ranked(_rerank(index, routed, length, k), k)
    if visited < router.parts:
        best = common.written(best, "ann-found")
        full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        short = asked.join(full, "vec_id", "left_anti")
        if not short.isEmpty():  # their partitions held too few rows: the others come too
            every = common.written(short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(router.parts - 1))))
                                   .select("part", "vec_id", "embedding"), "ann-queries")
            more = _ranked(_rerank(index, every, length, k), k)
            best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    return best


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _rerank(index: DataFrame, routed: DataFrame, length: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): exact scores of the k best rows of each block that a routed query meets."""
    # one row per partition: in how many blocks its rows, and the queries that visit it, are dealt
    n_rows = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    n_asked = routed.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("query_blocks"))
    sizes = n_rows.join(n_asked, "part")  # at most MAX_PARTITIONS rows
    sizes = F.broadcast(sizes)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (routed.join(sizes, "part").withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int"))
            .withColumn("b", upto("blocks")).select("part", "b", "qb", "vec_id", "embedding"))
    right = (index.join(sizes, "part").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
             .withColumn("qb", upto("query_blocks")).select("part", "b", "qb", "vec_id", "embedding"))
    key = ["part", "b", "qb"]

    def rank(_, q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            a, b, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            a, b, s = best_of(matrix(q.column("embedding"), length), q.column("vec_id").to_numpy(),
                              matrix(d.column("embedding"), length), d.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return (left.groupBy(*key).cogroup(right.groupBy(*key))
            .applyInArrow(rank, "query_id bigint, vec_id bigint, score double"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found for every row whose vec_id is divisible by 50."""
    common.ready(spark)
    rows = common.read(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
