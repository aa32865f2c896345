"""Top-k similarity join (cosine, threshold, best k per question) without a cross join.

Plan
----
1. Coarse cells: ``n_cells`` centroids are documents picked in hash order (or
   the first by id), optionally moved by Spark ML's k-means over cosine.
2. Every document goes to its nearest cell, once (the assignment is written to
   the shared folder); per cell Spark computes the size and the radius
   ``max |x̂ - c|`` (one row per cell reaches the driver).
3. Exact search has two phases.  First each question searches its nearest cell,
   which gives it a k-th best score.  Then it visits every other cell whose
   upper bound ``cos(max(0, angle(q, c) - alpha_c))`` reaches both the threshold
   and that score, ``alpha_c`` being the largest angle between the centroid and
   a member (triangle inequality for angles on the sphere), so no document of
   the answer is skipped.  Approximate search visits the ``nprobe`` nearest cells.
4. Cells are joined to groups of at most ``B`` documents, so that a question
   travels once per group, packed, with a bit per cell it visits.  Hot cells are
   split: documents of group ``g`` get ``S_g = ceil(size/B)`` blocks, the
   questions visiting it ``Q_g = ceil(visits/262144)`` blocks, and each pair
   ``(doc_block, q_block)`` is a task.  Its rows come sorted, documents first: it
   holds about ``B`` documents however skewed the data, and the questions pass
   by some at a time.  So ``B`` is large (32 MB of packed vectors), and what
   travels is ``questions * documents / B`` rows and as few candidates.
5. Inside a block numpy bounds the cosine of every pair (float32 products with
   an error bound, see ``block_scores``), scores exactly only the pairs that can
   be among the best ``k`` and keeps those; a ranking window (planned as a partial + final window group limit) picks the
   global best ``k`` per question.

Scores are ``dot(q, d) / sqrt(|q|² · |d|²)`` with the dot product summed in
dimension order in float64 (integer count vectors: exact), so they are the
same numbers any engine gets when summing in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe import rules
from askframe.operators import block_scores
from askframe.operators.block_scores import unit_rows as _unit
from askframe.operators.util import materialize
from askframe.session import few_listing_tasks, ship_package
from askframe.sources.commit_log import CommitLog

BLOCK_BYTES = 32 << 20  # packed vectors of the documents that a block holds
BLOCK_QUESTIONS = 262144  # questions that pass by in one block
QUESTIONS = 8192  # of them, those that are held at once


def _collect_vectors(df: DataFrame, col: str) -> np.ndarray:
    """A bounded vector column to an ``n x dim`` float64 matrix through Arrow (no per-float Python objects)."""
    table = df.select(col).toArrow()
    values = table.column(0).combine_chunks()
    if len(values) == 0:
        return np.zeros((0, 0))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _matrix(series, dtype=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=dtype) for v in series]) if len(series) else np.zeros((0, 0))


def _seq_sq(m: np.ndarray) -> np.ndarray:
    acc = np.zeros(m.shape[0], dtype=np.float64)
    for j in range(m.shape[1]):
        acc += m[:, j] * m[:, j]
    return acc


def _centroids(docs: DataFrame, n_cells: int, seeds: str, refine_steps: int, sample_rows: int, dim: int) -> np.ndarray:
    """At most ``n_cells`` unit centroids: documents in hash order (``seeds="hash"``) or by id (``"first"``).

    ``refine_steps`` rounds of Spark ML's k-means (cosine) over about
    ``sample_rows`` documents in hash order may replace them.
    """
    nonzero = docs.filter(F.exists("_v", lambda x: x != 0))
    order = F.xxhash64(F.col("_did")) if seeds == "hash" else F.col("_did")
    if refine_steps > 0 and n_cells > 1:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        part = min(1.0, sample_rows / max(1, docs.count()))
        sample = (nonzero.filter(F.pmod(F.xxhash64("_did"), F.lit(1 << 20)) < F.lit(part * (1 << 20)))
                  .select(array_to_vector(F.col("_v").cast("array<double>")).alias("features")))
        if not sample.isEmpty():
            model = KMeans(k=n_cells, distanceMeasure="cosine", maxIter=refine_steps, seed=7, initMode="random").fit(sample)
            x = _unit(np.asarray(model.clusterCenters()))
            return x[np.abs(x).sum(axis=1) > 0]
    x = _unit(_collect_vectors(nonzero.select("_v", order.alias("_o"), "_did").orderBy("_o", "_did").limit(n_cells), "_v"))
    return x if len(x) else np.zeros((1, dim))


def _assign(docs: DataFrame, cents_bc, integer: bool, among: np.ndarray | None = None) -> DataFrame:
    """Adds ``_n`` (squared norm), ``_cell`` (nearest centroid, of those ``among``) and ``_dist`` (distance of the unit vector)."""
    schema = T.StructType(list(docs.schema.fields) + [
        T.StructField("_n", T.DoubleType()), T.StructField("_cell", T.IntegerType()),
        T.StructField("_dist", T.DoubleType())])

    def run(batches):
        cents = cents_bc.value
        step = max(1, PROBED // max(1, *cents.shape))
        for pdf in (pdf.iloc[at:at + step] for pdf in batches for at in range(0, len(pdf), step)):
            m = _matrix(pdf["_v"])
            sq = (m * m).sum(axis=1) if integer else _seq_sq(m)
            u = _unit(m)
            sims = u @ cents.T
            if among is not None:
                sims[:, ~among] = -np.inf
            cell = sims.argmax(axis=1)
            dist = np.sqrt(np.maximum(((u - cents[cell]) ** 2).sum(axis=1), 0.0))
            out = pdf.copy()
            out["_n"] = sq
            out["_cell"] = cell.astype(np.int32)
            out["_dist"] = dist
            yield out
    return docs.mapInPandas(run, schema)


@dataclass
class CellIndex:
    """Documents assigned to coarse cells, plus the bounded per-cell arrays a search needs.

    ``assigned`` has ``_did, _v, _n, _cell, _dist`` (and any payload columns);
    ``centroids``/``radius``/``counts`` have one entry per cell (at most ``max_cells``).
    """

    assigned: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    integer: bool
    did: str
    vec: str


def build_cells(docs: DataFrame, *, did: str = "doc_id", vec: str = "embedding", integer: bool = False,
                cell_rows: int = 1024, refine_steps: int = 0, seeds: str = "hash", max_cells: int = 4096,
                sample_rows: int = 32768, payload: list[str] | None = None) -> CellIndex | None:
    """Cluster documents into ``ceil(n / cell_rows)`` cells; ``None`` when there are no documents.

    ``max_cells`` bounds what is broadcast (``max_cells x dim`` numbers); above
    ``max_cells * cell_rows`` documents the cells grow, and are searched in
    blocks.  ``sample_rows`` bounds the k-means sample (``refine_steps`` > 0).
    """
    ship_package(docs.sparkSession)
    cols = [F.col(did).alias("_did"), F.col(vec).alias("_v")] + [F.col(c) for c in (payload or [])]
    # a document without a vector can never match; ``docs`` is read a few times, so pass a stored or materialised frame
    d = docs.select(*cols).filter(F.col("_v").isNotNull())
    n_docs = d.count()
    if n_docs == 0:
        return None
    dim = max(1, d.select(F.size("_v")).first()[0] or 1)
    n_cells = max(1, min(max_cells, math.ceil(n_docs / cell_rows)))
    cents = _centroids(d, n_cells, seeds, refine_steps, sample_rows, dim)
    # at most max_cells x dim doubles: a bounded broadcast, shipped once per executor
    cents_bc = docs.sparkSession.sparkContext.broadcast(cents)
    assigned = materialize(_assign(d, cents_bc, integer))
    radius, counts = _cell_bounds(assigned, len(cents))
    return CellIndex(assigned, cents, radius, counts, integer, did, vec)


def _cell_bounds(assigned: DataFrame, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    radius, counts = np.zeros(n_cells), np.zeros(n_cells, dtype=np.int64)
    for c, n, r in assigned.groupBy("_cell").agg(F.count(F.lit(1)), F.max("_dist")).collect():
        radius[c], counts[c] = r or 0.0, n
    return radius, counts


FILE_ROWS = 32768  # rows of one file, or of one task that writes cells


def dealt_by_cell(index: CellIndex) -> DataFrame:
    """``index.assigned`` with each cell's rows together, so that it is written as one file per cell, or one per ``FILE_ROWS`` of it.

    Else every task writes a file for every cell: tasks times cells of them.
    """
    spark = index.assigned.sparkSession
    large = [(int(c), math.ceil(int(index.counts[c]) / FILE_ROWS)) for c in np.flatnonzero(index.counts > FILE_ROWS)]
    parts = F.broadcast(spark.createDataFrame(large, "_cell int, _parts int"))  # at most max_cells rows
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(index.counts.sum()) / FILE_ROWS))
    part = F.pmod(F.xxhash64("_did"), F.coalesce("_parts", F.lit(1)))
    return index.assigned.join(parts, "_cell", "left").repartition(n, "_cell", part).select(*index.assigned.columns)


def write_index(index: CellIndex, path: str) -> None:
    """Persist an index: documents partitioned by batch and cell (searches read only probed cells) + a cells table."""
    CommitLog(index.assigned.sparkSession, path).clear()  # a rebuild forgets what compactions did
    for folder, df in (("data", dealt_by_cell(index).withColumn("batch", F.lit("build"))),
                       ("cells", _cells_frame(index, range(len(index.centroids))).withColumn("batch", F.lit("build")))):
        parts = ["batch", "_cell"] if folder == "data" else ["batch"]
        (df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts)
           .parquet(f"{path}/{folder}"))


def _cells_frame(index: CellIndex, cells) -> DataFrame:
    rows = [(int(c), index.centroids[c].tolist(), float(index.radius[c]), int(index.counts[c]),
             f"{int(index.integer)}|{index.did}|{index.vec}") for c in cells]
    return index.assigned.sparkSession.createDataFrame(
        rows, "cell int, centroid array<double>, radius double, n long, meta string").coalesce(1)


def add_to_index(spark, path: str, docs: DataFrame, key: str) -> None:
    """Add documents to a stored index under a batch ``key``; the same key again replaces that batch.

    A batch that a compaction has taken in is final: its key again does nothing.  Each document goes to the nearest stored centroid.  The batch's own cell
    sizes and radii are stored beside those of the build; readers add up the
    sizes and take the largest radius, so exact search stays exact.
    """
    ship_package(spark)
    if key.startswith(COMPACTED):
        raise ValueError(f"not a batch key: {key!r}")
    if key in snapshot(spark, path)["retired"]:
        return
    index = read_index(spark, path)
    payload = [c for c in index.assigned.columns if not c.startswith("_")]
    missing = [c for c in [index.did, index.vec, *payload] if c not in docs.columns]
    if missing:
        raise ValueError(f"the index at {path} needs columns {missing}")
    d = docs.select(F.col(index.did).alias("_did"), F.col(index.vec).alias("_v"), *payload).filter(F.col("_v").isNotNull())
    # a cell that was split has no documents: new ones go to the cells it was split into
    assigned = materialize(_assign(d, spark.sparkContext.broadcast(index.centroids), index.integer,
                                   index.counts > 0 if index.counts.any() else None))
    radius, counts = _cell_bounds(assigned, len(index.centroids))
    added = CellIndex(assigned, index.centroids, radius, counts, index.integer, index.did, index.vec)
    dealt_by_cell(added).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_cell") \
        .parquet(f"{path}/data/batch={key}")
    _cells_frame(added, np.flatnonzero(counts)).write.mode("overwrite").parquet(f"{path}/cells/batch={key}")


COMPACTED = "compact-"


def snapshot(spark, path: str) -> dict:
    """What compactions have made of a stored index: the latest published snapshot.

    ``live`` compacted batches count, ``retired`` batches don't, and neither do
    the ``split`` cells of the batches named there; every other batch counts.
    """
    log = CommitLog(spark, path)
    numbers = [n for n in log.names("snapshots") if n.isdigit()]
    snap = log.read(f"snapshots/{max(numbers)}") if numbers else {"number": -1, "live": [], "retired": [], "split": {}}
    batches = [n.removeprefix("batch=") for n in log.names("../data") if n.startswith("batch=")]
    unseen = [b for b in batches if b.startswith(COMPACTED) and b not in snap["live"]]  # not published
    return {**snap, "hidden": sorted({*unseen, *snap["retired"]})}


def counted(table: DataFrame, snap: dict, cell: str) -> DataFrame:
    """The rows of an index folder (``data`` or ``cells``) that a snapshot counts; filters on partition columns."""
    batch = F.col("batch").cast("string")
    if snap["hidden"]:
        table = table.filter(~batch.isin(snap["hidden"]))
    for name, cells in snap["split"].items():
        table = table.filter(~((batch == name) & F.col(cell).isin(cells)))
    return table


def read_index(spark, path: str) -> CellIndex:
    snap = snapshot(spark, path)
    with few_listing_tasks(spark):  # a folder per batch and cell
        stored = spark.read.parquet(f"{path}/data")
    # one row per cell and batch, joined here to one per cell: bounded by max_cells
    cells = (counted(spark.read.parquet(f"{path}/cells"), snap, "cell").groupBy("cell", "meta")
             .agg(F.max("centroid").alias("centroid"), F.max("radius").alias("radius"), F.sum("n").alias("n"))
             .orderBy("cell"))
    cells = materialize(cells)
    small = cells.orderBy("cell").select("cell", "radius", "n", "meta").toArrow().to_pandas()
    integer, did, vec = small["meta"].iloc[0].split("|")
    cents = _collect_vectors(cells.orderBy("cell"), "centroid")
    radius = small["radius"].to_numpy(dtype=np.float64)
    counts = small["n"].to_numpy(dtype=np.int64)
    return CellIndex(counted(stored, snap, "_cell").drop("batch"), cents, radius, counts, bool(int(integer)), did, vec)


SAMPLE_QUESTIONS = 256


def sampled_questions(queries: DataFrame, qid: str, n: int = SAMPLE_QUESTIONS) -> DataFrame:
    """At most ``n`` questions: those whose id has the smallest MD5, the same on every run."""
    return queries.orderBy(F.md5(F.col(qid).cast("string")), F.col(qid)).limit(n)


def cell_depths(questions: DataFrame, index: CellIndex, *, qid: str, vec: str, k: int, threshold: float) -> DataFrame:
    """``(qid, _depth)``, one row per exact answer of a few questions: the how-manieth nearest cell holds it.

    The answers (``k`` per question) go to the documents to learn their cells,
    and each question ranks its cells once, in the worker, to look up those.
    """
    exact = materialize(search_cells(questions, index, qid=qid, vec=vec, k=k, threshold=threshold).select(qid, index.did))
    at = index.assigned.select(F.col("_did").alias(index.did), "_cell").join(F.broadcast(exact), index.did)  # k rows per question
    cells = at.groupBy(qid).agg(F.collect_list("_cell").alias("_cells"))
    cents_bc, nonempty = questions.sparkSession.sparkContext.broadcast(index.centroids), index.counts > 0

    def depths(batches):
        for pdf in batches:
            for at_ in range(0, len(pdf), 64):
                part = pdf.iloc[at_:at_ + 64]
                sims = np.where(nonempty[None, :], _unit(_matrix(part[vec])) @ cents_bc.value.T, -np.inf)
                place = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1, kind="stable")
                found = [place[i, np.asarray(c)] + 1 for i, c in enumerate(part["_cells"])]
                yield pd.DataFrame({qid: np.repeat(part[qid].to_numpy(), [len(f) for f in found]),
                                    "_depth": np.concatenate(found).astype(np.int32)})

    schema = T.StructType([questions.schema[qid], T.StructField("_depth", T.IntegerType())])
    return questions.select(qid, vec).join(cells, qid).mapInPandas(depths, schema)


def depth_for_recall(depths: dict, recall: float, confidence: float) -> int:
    """The least depth at which the lower confidence bound of the share of answers found reaches ``recall``.

    ``depths`` has the depths of each question's answers.  The share is a ratio
    of two sums over questions; its error is that of the linearised ratio, so
    answers of one question count together.
    """
    z, n = NormalDist().inv_cdf(confidence), len(depths)
    total = np.asarray([len(d) for d in depths.values()], dtype=np.float64)
    for m in sorted({x for d in depths.values() for x in d}):
        found = np.asarray([sum(x <= m for x in d) for d in depths.values()], dtype=np.float64)
        share = found.sum() / total.sum()
        off = max(0.0, float((found * found).sum() - 2 * share * (found * total).sum() + share * share * (total * total).sum()))
        if share - z * math.sqrt(off * n / max(1, n - 1)) / total.sum() >= recall:
            return int(m)
    return 1  # no question has an answer


def nprobe_for_recall(queries: DataFrame, index: CellIndex, *, recall: float = 0.9, confidence: float = 0.95,
                      sample: int = SAMPLE_QUESTIONS, qid: str = "query_id", vec: str = "embedding",
                      k: int = rules.TOP_K, threshold: float = rules.SCORE_THRESHOLD) -> int:
    """How many nearest cells to search for ``recall`` of the exact answers, with ``confidence``.

    Estimated on at most ``sample`` questions: only these are searched exactly,
    so the cost does not depend on the number of questions, and at most
    ``sample * k`` numbers reach the driver.
    """
    few = materialize(sampled_questions(queries.select(qid, vec).filter(F.col(vec).isNotNull()), qid, sample))
    depths: dict = {}
    for q, d in cell_depths(few, index, qid=qid, vec=vec, k=k, threshold=threshold).collect():
        depths.setdefault(q, []).append(d)
    return depth_for_recall(depths, recall, confidence)


def search_cells(queries: DataFrame, index: CellIndex | None, *, qid: str = "query_id",
                 vec: str = "embedding", k: int = rules.TOP_K, threshold: float = rules.SCORE_THRESHOLD,
                 mode: str = "exact", nprobe: int = 4, block_rows: int | None = None,
                 did_type=None, stats: dict | None = None) -> DataFrame:
    """Top-k per question against a cell index (built on the fly or read from storage).

    ``stats`` (optional dict) receives ``pairs_scored`` (question-document pairs
    in the cells visited, whose scores are bounded), ``pairs_total``,
    ``cells_probed`` and two accumulators, whose ``value`` holds once the search
    has run: ``pairs_exact`` (pairs scored exactly) and ``pairs_touched`` (count
    vectors: those of them with a bucket in common).
    """
    if k is None or k <= 0:
        k = rules.TOP_K
    ship_package(queries.sparkSession)
    qtype = queries.schema[qid].dataType
    if index is None:
        return _empty(queries, qid, "doc_id", qtype, did_type or T.StringType())
    did, dtype_ = index.did, index.assigned.schema["_did"].dataType
    q = materialize(queries.select(F.col(qid).alias("_qid"), F.col(vec).alias("_v")).filter(F.col("_v").isNotNull()))
    if stats is not None:
        stats.update(pairs_scored=0, cells_probed=0, cells=int(len(index.centroids)),
                     pairs_total=int(q.count()) * int(index.counts.sum()))
        sc = queries.sparkSession.sparkContext
        stats.update(pairs_exact=sc.accumulator(0), pairs_touched=sc.accumulator(0))
    find = dict(k=k, threshold=float(threshold), block_rows=block_rows, stats=stats)
    if mode != "exact":
        cands = _search(q, index, nearest=max(1, nprobe), **find)
    elif int((index.counts > 0).sum()) <= 1:
        cands = _search(q, index, nearest=None, **find)
    else:
        q = materialize(_with_nearest(q, index))
        cands = _search(q, index, nearest=1, **find)
        if cands is not None:
            # the k-th best score so far: other cells matter only if they can reach it
            cands = materialize(cands)
            w = Window.partitionBy("_qid").orderBy(F.desc("raw_score"))
            kth = (cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k)
                   .select("_qid", F.col("raw_score").alias("_floor")))
            rest = _search(q.join(kth, "_qid", "left"), index, nearest=None, **find)
            cands = cands if rest is None else cands.unionByName(rest)
    if cands is None:
        return _empty(queries, qid, did, qtype, dtype_)
    w = Window.partitionBy("_qid").orderBy(F.desc("raw_score"), F.asc("_did"))
    ranked = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_qid").alias(qid), F.col("_did").alias(did), F.col("rank"),
                         F.round("raw_score", 4).alias("score"), F.col("raw_score"))


PROBED = 1 << 20  # (row, cell) similarities computed at once


def _similar_cells(m: np.ndarray, cents: np.ndarray, nonempty: np.ndarray) -> np.ndarray:
    """Cosine of each row with each centroid; -inf for cells without documents."""
    return np.where(nonempty[None, :], _unit(m) @ cents.T, -np.inf)


def _with_nearest(q: DataFrame, index: CellIndex) -> DataFrame:
    """``q`` with ``_near``, each question's nearest cell.

    Where two cells are equally near, their products may differ in the last bit from one batch of rows to another: so the cell is
    found once, and what the first phase visits is what the second leaves out.
    """
    cents_bc, nonempty = q.sparkSession.sparkContext.broadcast(index.centroids), index.counts > 0

    def run(batches):
        step = max(1, PROBED // max(1, len(nonempty)))
        for pdf in (pdf.iloc[at:at + step] for pdf in batches for at in range(0, len(pdf), step)):
            yield pdf.assign(_near=_similar_cells(_matrix(pdf["_v"]), cents_bc.value, nonempty).argmax(axis=1).astype(np.int32))

    return q.mapInPandas(run, T.StructType([*q.schema.fields, T.StructField("_near", T.IntegerType())]))


def _search(q: DataFrame, index: CellIndex, *, nearest: int | None, k: int, threshold: float, block_rows: int | None,
            stats: dict | None) -> DataFrame | None:
    """Candidates (_qid, _did, raw_score) of the cells that each question visits; None if none is visited.

    ``nearest``: the number of nearest cells (one: that of the column ``_near``
    where ``q`` has it); None: every cell whose bound reaches the threshold, or,
    where ``q`` has a column ``_floor`` (null: no k-th score yet), every one but
    ``_near`` whose bound reaches both.
    """
    spark, integer = q.sparkSession, index.integer
    qtype = q.schema["_qid"].dataType
    dtype_ = index.assigned.schema["_did"].dataType
    cents_bc = spark.sparkContext.broadcast(index.centroids)
    # largest angle between a cell's centroid and its members (|u - c| = 2 sin(angle / 2))
    alpha = 2.0 * np.arcsin(np.clip(index.radius / 2.0, 0.0, 1.0))
    nonempty = index.counts > 0
    second = "_floor" in q.columns

    def visited(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) pairs and the vectors of a slice of questions."""
        m = _matrix(pdf["_v"])
        if nearest == 1 and "_near" in pdf:
            return np.arange(len(m)), pdf["_near"].to_numpy(), m
        sims = _similar_cells(m, cents_bc.value, nonempty)
        if nearest is not None:
            hit = np.zeros_like(sims, dtype=bool)
            np.put_along_axis(hit, np.argsort(-sims, axis=1, kind="stable")[:, :nearest], True, axis=1)
        else:
            floor = np.full(len(m), threshold)
            if second:
                floor = np.maximum(floor, pdf["_floor"].astype(float).fillna(-np.inf).to_numpy() - 1e-9)
            # angle(q, x) >= angle(q, c) - alpha_c on the sphere, so cos(q, x) <= cos(max(0, that))
            phi = np.arccos(np.clip(sims, -1.0, 1.0))
            hit = np.cos(np.maximum(0.0, phi - alpha[None, :])) + 1e-6 >= floor[:, None]
            if threshold <= 0 and not second:
                hit[:] = True
            hit |= (floor <= 0)[:, None]  # a zero vector has score 0 wherever it lies
            if second:
                hit[np.arange(len(m)), pdf["_near"].to_numpy()] = False
        rows, cells = np.nonzero(hit & nonempty[None, :])
        return rows, cells, m

    def slices(batches):
        step = max(1, PROBED // max(1, len(nonempty)))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                yield pdf.iloc[at:at + step]

    # counts mostly travel as a byte each; smaller blocks for fewer documents, else there were too few tasks
    width = 1 if integer else 8 if isinstance(index.assigned.schema["_v"].dataType.elementType, T.DoubleType) else 4
    held = max(1, BLOCK_BYTES // max(1, width * index.centroids.shape[1]))
    block_rows = min(block_rows or held, held, max(2048, int(index.counts.sum()) // 16))
    groups, group_of, place = _cell_groups(index.counts, block_rows)

    def count(batches):
        n, asked = np.zeros(len(nonempty), dtype=np.int64), np.zeros(len(groups), dtype=np.int64)
        for pdf in slices(batches):
            rows, cells, _ = visited(pdf)
            n += np.bincount(cells, minlength=len(n))
            asked += np.bincount(np.unique(rows * len(groups) + group_of[cells]) % len(groups), minlength=len(groups))
        for of_group, x in ((False, n), (True, asked)):
            yield pd.DataFrame({"of_group": of_group, "number": np.flatnonzero(x).astype(np.int32), "n": x[x > 0]})

    def probes(batches):
        for pdf in slices(batches):
            rows, cells, m = visited(pdf)
            sq = (m * m).sum(axis=1) if integer else _seq_sq(m)
            need = np.full(len(m), threshold)
            if second:
                need = np.maximum(need, pdf["_floor"].astype(float).fillna(-np.inf).to_numpy())
            packed = np.array([block_scores.pack(np.asarray(v)) for v in pdf["_v"]], dtype=object)
            hit = np.zeros((len(m), len(nonempty)), dtype=bool)
            hit[rows, cells] = True
            for g in np.unique(group_of[cells]).tolist():
                here = hit[:, groups[g]]
                asks = np.flatnonzero(here.any(axis=1))
                yield pd.DataFrame({"_qid": pdf["_qid"].to_numpy()[asks], "_v": packed[asks], "_n": sq[asks], "_need": need[asks],
                                    "_visits": [x.tobytes() for x in np.packbits(here[asks], axis=1)], "_g": np.int32(g)})

    def packed_docs(batches):
        for pdf in batches:
            yield pd.DataFrame({"_cell": pdf["_cell"], "_did": pdf["_did"], "_n": pdf["_n"],
                                "_v": [block_scores.pack(np.asarray(v)) for v in pdf["_v"]]})

    per_task = q.mapInPandas(count, "of_group boolean, number int, n long")   # one row per cell or group and task
    totals = per_task.groupBy("of_group", "number").agg(F.sum("n").alias("n")).collect()
    visits = {r["number"]: r["n"] for r in totals if not r["of_group"]}
    asked = {r["number"]: r["n"] for r in totals if r["of_group"]}
    if not visits:
        return None
    if stats is not None:
        stats["pairs_scored"] += int(sum(n * int(index.counts[c]) for c, n in visits.items()))
        stats["cells_probed"] += len(visits)
    exact, touched = (stats["pairs_exact"], stats["pairs_touched"]) if stats is not None else (None, None)
    # one row per visited group and per visited cell (at most max_cells): in how many blocks documents and questions are dealt
    blocks = _blocks({g: int(index.counts[groups[g]].sum()) for g in asked}, asked, block_rows, 4 * spark.sparkContext.defaultParallelism)
    at, n_blocks = {}, 0  # number of a group's first block
    for g in sorted(blocks):
        at[g] = n_blocks
        n_blocks += blocks[g][0] * blocks[g][1]
    q_deal = F.broadcast(spark.createDataFrame([(g, *blocks[g], at[g]) for g in sorted(blocks)], "_g int, _dn int, _qn int, _at int"))
    d_deal = F.broadcast(spark.createDataFrame(
        [(int(c), int(place[c]), *blocks[int(group_of[c])], at[int(group_of[c])]) for c in sorted(visits)],
        "_cell int, _part int, _dn int, _qn int, _at int"))
    block = (F.col("_at") + F.col("_ds") * F.col("_qn") + F.col("_qs")).cast("int").alias("_block")
    doc_schema = T.StructType([T.StructField("_cell", T.IntegerType()), T.StructField("_did", dtype_),
                               T.StructField("_n", T.DoubleType()), T.StructField("_v", T.BinaryType())])
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    doc_side = (index.assigned.filter(F.col("_cell").isin(sorted(int(c) for c in visits)))  # prunes a stored index's folders
                .select("_cell", "_did", "_n", "_v").mapInPandas(packed_docs, doc_schema)
                .join(d_deal, "_cell").withColumn("_ds", F.pmod(F.xxhash64("_did"), F.col("_dn")).cast("int"))
                .withColumn("_qs", F.explode(F.sequence(F.lit(0), F.col("_qn") - 1)))
                .select(block, F.lit(False).alias("_asks"), "_part", "_did", none("_qid", qtype), "_v", "_n", none("_need", "double"),
                        none("_visits", "binary")))
    probe_schema = T.StructType([T.StructField("_qid", qtype), T.StructField("_v", T.BinaryType()), T.StructField("_n", T.DoubleType()),
                                 T.StructField("_need", T.DoubleType()), T.StructField("_visits", T.BinaryType()),
                                 T.StructField("_g", T.IntegerType())])
    q_side = (q.mapInPandas(probes, probe_schema).join(q_deal, "_g")
              .withColumn("_qs", F.pmod(F.xxhash64("_qid"), F.col("_qn")).cast("int"))
              .withColumn("_ds", F.explode(F.sequence(F.lit(0), F.col("_dn") - 1)))
              .select(block, F.lit(True).alias("_asks"), none("_part", "int"), none("_did", dtype_), "_qid", "_v", "_n", "_need", "_visits"))
    out_schema = T.StructType([T.StructField("_qid", qtype), T.StructField("_did", dtype_),
                               T.StructField("raw_score", T.DoubleType())])

    def found(docs, dids, dn, asked):
        """The best of a block for some of its questions."""
        qids, packed, qn, need, visits_ = (pa.concat_arrays(x) for x in zip(*asked))
        qm, qn, need = block_scores.unpack(packed.to_pylist()), qn.to_numpy(), need.to_numpy()
        visit = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in visits_.to_pylist()]), axis=1).astype(bool)
        rows, cols, s = docs.pairs(qm, k, need, visit)
        if exact is not None:
            exact.add(len(rows))
        if touched is not None and integer:
            touched.add(int((s != 0).sum()))
        # float64 on both sides: the product of two integer norms may not fit 64 bits
        denom = np.sqrt(qn[rows] * dn[cols])
        sc_ = np.divide(s, denom, out=np.zeros_like(s), where=denom > 0)
        kept = sc_ >= need[rows]
        rows, cols, sc_ = rows[kept], cols[kept], sc_[kept]
        met, tie = np.unique(cols, return_inverse=True)
        tie = pc.rank(dids.take(pa.array(met)), null_placement="at_end", tiebreaker="first").to_numpy()[tie]
        order = np.lexsort((tie, -sc_, rows))
        rows, cols, sc_ = rows[order], cols[order], sc_[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return pa.RecordBatch.from_arrays([qids.take(pa.array(rows[kept])), dids.take(pa.array(cols[kept])), pa.array(sc_[kept])],
                                          names=["_qid", "_did", "raw_score"])

    def score(batches):
        """A block's documents are held, its questions pass by some at a time."""
        block, docs, dids, dn, asked = None, None, [], [], []

        def answers():
            if len(dids) > 1:  # the documents are all there now
                dids[:], dn[:] = [pa.concat_arrays(dids)], [np.concatenate(dn)]
            out = found(docs, dids[0], dn[0], asked)
            asked.clear()
            return out

        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for begin, end in zip(np.append(0, cuts), np.append(cuts, len(number))):
                part = batch.slice(begin, end - begin)
                if number[begin] != block:
                    if asked and dids:
                        yield answers()
                    block, docs, dids, dn, asked = number[begin], block_scores.Documents(k), [], [], []
                if asks[begin]:
                    asked.append([part.column(name) for name in ("_qid", "_v", "_n", "_need", "_visits")])
                    if dids and sum(len(x[0]) for x in asked) >= QUESTIONS:
                        yield answers()
                else:
                    docs.add(part.column("_v").to_pylist(), part.column("_part").to_numpy(), sum(map(len, dn)))
                    dids.append(pa.concat_arrays([part.column("_did")]))
                    dn.append(part.column("_n").to_numpy(zero_copy_only=False).copy())
        if asked and dids:
            yield answers()

    return (doc_side.unionAll(q_side).repartitionById(n_blocks, F.col("_block"))
            .sortWithinPartitions("_block", "_asks", "_part", F.asc_nulls_last("_did")).mapInArrow(score, out_schema))


def _blocks(held: dict[int, int], asked: dict[int, int], rows: int, tasks: int) -> dict[int, tuple[int, int]]:
    """For each group, of so many documents and questions, in how many blocks its documents and its questions are dealt.

    Questions pass by without being held, and documents travel once per block of
    questions: so these are large, but enough of them for some ``tasks``.
    """
    docs = {g: max(1, math.ceil(n / rows)) for g, n in held.items()}
    few = math.ceil(tasks / max(1, sum(docs.values())))
    return {g: (docs[g], max(1, math.ceil(n / BLOCK_QUESTIONS), min(few, math.ceil(n / QUESTIONS)))) for g, n in asked.items()}


def _cell_groups(counts: np.ndarray, rows: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cells in order joined to groups of at most ``rows`` documents (a larger cell alone); each cell's group and place in it."""
    groups, size = [[0]], int(counts[0])
    for c in range(1, len(counts)):
        if size + counts[c] > rows:
            groups.append([])
            size = 0
        groups[-1].append(c)
        size += int(counts[c])
    group_of, place = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    for g, cells in enumerate(groups):
        group_of[cells], place[cells] = g, np.arange(len(cells))
    return [np.asarray(cells) for cells in groups], group_of, place


def similarity_topk(queries: DataFrame, docs: DataFrame, *, qid: str = "query_id", did: str = "doc_id",
                    vec: str = "embedding", k: int = rules.TOP_K, threshold: float = rules.SCORE_THRESHOLD,
                    integer: bool = False, mode: str = "exact", nprobe: int = 4,
                    cell_rows: int = 1024, block_rows: int | None = None, refine_steps: int = 0,
                    seeds: str = "hash") -> DataFrame:
    """``(qid, did, rank, score, raw_score)``: up to ``k`` documents per question with score ≥ threshold.

    ``integer=True`` takes integer count vectors (``array<int>``) and scores
    them exactly.  Ties are broken by ``did``; ``score`` is rounded to 4 places
    after ranking on the unrounded ``raw_score``.  The cells are built on the
    fly; ``build_cells`` + ``write_index`` / ``read_index`` keep them for reuse.
    """
    index = build_cells(docs, did=did, vec=vec, integer=integer, cell_rows=cell_rows,
                        refine_steps=refine_steps, seeds=seeds)
    if index is None:
        return _empty(queries, qid, did, queries.schema[qid].dataType, docs.schema[did].dataType)
    return search_cells(queries, index, qid=qid, vec=vec, k=k, threshold=threshold, mode=mode,
                        nprobe=nprobe, block_rows=block_rows)


def _empty(queries: DataFrame, qid, did, qtype, dtype_) -> DataFrame:
    return queries.sparkSession.createDataFrame([], T.StructType([
        T.StructField(qid, qtype), T.StructField(did, dtype_), T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("raw_score", T.DoubleType())]))
