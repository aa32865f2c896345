"""Upkeep of a stored cell index: over-full cells are split, small batches are put together.

Appends only ever add: cells grow, their radii widen, and every batch is a set
of small files.  ``compact_index`` rewrites what needs it and nothing else:

* a cell with more than ``cell_rows`` documents gets local centroids (members in
  hash order), its documents go to the nearest of them; what no centroid can
  take apart (copies of one vector) is dealt by hash to cells that share a
  centroid, so no cell stays beyond the bound;
* the rows of batches smaller than ``small_rows`` move into the compacted batch.

The compacted batch becomes visible with the snapshot that names it, together
with what it replaces: one file, published under the next number or not at all.
Readers see the state before or after, appends need not know (a batch folder
that no snapshot retires counts), and of two compactions at a time the second
gives up.  ``vacuum_index`` deletes what no snapshot needs any more.

Cells stay within ``max_cells`` (they travel to the workers); beyond
``max_cells * cell_rows / 2`` documents the bound grows in proportion.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askframe.operators.similarity import (COMPACTED, CellIndex, _cell_bounds, _cells_frame, _collect_vectors, _matrix, _unit, counted,
                                           dealt_by_cell, read_index, snapshot)
from askframe.operators.util import materialize
from askframe.session import few_listing_tasks, ship_package
from askframe.sources.commit_log import CommitLog

MAX_CELLS = 4096


def cell_bound(n_docs: int, cell_rows: int, max_cells: int = MAX_CELLS) -> int:
    return max(cell_rows, math.ceil(2 * n_docs / max_cells))


def _local_centroids(rows: DataFrame, wanted: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """For each cell its ``wanted`` (rows, centroids): that many members in hash order, about; at most MAX_CELLS in all."""
    rate = rows.sparkSession.createDataFrame([(c, min(1.0, 3.0 * m / n), m) for c, (n, m) in wanted.items()],
                                             "_cell int, _rate double, _m int")
    h = F.xxhash64("_did")
    some = (rows.join(F.broadcast(rate), "_cell").filter(F.pmod(h, F.lit(1 << 20)) <= F.col("_rate") * (1 << 20))
            .withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy(h, "_did"))).filter(F.col("_r") <= F.col("_m"))
            .select("_cell", "_v", "_r").orderBy("_cell", "_r"))
    some = materialize(some)
    cells = np.asarray([r["_cell"] for r in some.select("_cell", "_r").orderBy("_cell", "_r").collect()])
    found = _unit(_collect_vectors(some.orderBy("_cell", "_r"), "_v"))
    return {int(c): found[cells == c] for c in np.unique(cells)}


def _to_local(rows: DataFrame, local: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """``rows`` with ``_cell`` and ``_dist`` by the local centroids: cell -> (number of the first, centroids)."""
    local_bc = rows.sparkSession.sparkContext.broadcast(local)  # MAX_CELLS x dim numbers at most

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.copy()
            cell, dist = pdf["_cell"].to_numpy().copy(), pdf["_dist"].to_numpy().copy()
            for c in np.unique(cell):
                if int(c) in local_bc.value:
                    first, cents = local_bc.value[int(c)]
                    at = np.flatnonzero(pdf["_cell"].to_numpy() == c)
                    u = _unit(_matrix(pdf["_v"].iloc[at]))
                    near = (u @ cents.T).argmax(axis=1)
                    cell[at], dist[at] = first + near, np.sqrt(np.maximum(((u - cents[near]) ** 2).sum(axis=1), 0.0))
            pdf["_cell"], pdf["_dist"] = cell.astype(np.int32), dist
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def _dealt(rows: DataFrame, parts: dict[int, tuple[int, int]]) -> DataFrame:
    """``rows`` of cells that centroids could not take apart, dealt by hash: cell -> (number of the first new one, parts)."""
    if not parts:
        return rows
    deal = rows.sparkSession.createDataFrame([(c, first, n) for c, (first, n) in parts.items()], "_cell int, _first int, _parts int")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("_did")), F.col("_parts"))
    return (rows.join(F.broadcast(deal), "_cell", "left")
            .withColumn("_cell", F.when(F.col("_parts").isNull(), F.col("_cell"))
                        .otherwise(F.when(part == 0, F.col("_cell")).otherwise(F.col("_first") + part - 1)).cast("int"))
            .select(*rows.columns))


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}  # one row per cell


def compact_index(spark: SparkSession, path: str, cell_rows: int = 1024, small_rows: int | None = None,
                  max_cells: int = MAX_CELLS) -> bool:
    """Split cells beyond ``cell_rows`` and join batches under ``small_rows`` (``cell_rows`` by default).

    Returns whether a new snapshot was published; False if there was nothing to
    do, or another compaction came first.
    """
    ship_package(spark)
    snap, log = snapshot(spark, path), CommitLog(spark, path)
    index = read_index(spark, path)
    stored = counted(spark.read.parquet(f"{path}/cells"), snap, "cell")
    of_batch = {r["b"]: r["n"] for r in stored.groupBy(F.col("batch").cast("string").alias("b")).agg(F.sum("n").alias("n")).collect()}
    small = sorted(b for b, n in of_batch.items() if n < (small_rows or cell_rows))
    small = small if len(small) > 1 else []
    bound = cell_bound(int(index.counts.sum()), cell_rows, max_cells)
    over = {int(c): int(index.counts[c]) for c in np.flatnonzero(index.counts > bound)}
    if not small and not over:
        return False

    with few_listing_tasks(spark):
        data = spark.read.parquet(f"{path}/data")
    data = counted(data, snap, "_cell").withColumn("batch", F.col("batch").cast("string"))
    moved = data.filter(F.col("batch").isin(small) | F.col("_cell").isin(list(over))).drop("batch")
    moved = materialize(moved)
    cents = index.centroids
    if over:
        room = max(0, max_cells - len(cents))
        wanted = {c: (n, max(2, math.ceil(2 * n / bound))) for c, n in over.items()}
        found = _local_centroids(moved.filter(F.col("_cell").isin(list(over))), wanted)
        local, first = {}, len(cents)
        for c, x in sorted(found.items()):
            x = np.unique(x, axis=0)[:room]
            if len(x):
                local[c], first, room = (first, x), first + len(x), room - len(x)
        cents = np.vstack([cents, *(x for _, x in local.values())])
        moved = materialize(_to_local(moved, local))
        sizes, tried = _sizes(moved), 0
        while room > 0 and tried < 12:  # copies of one vector: each round deals what is still beyond the bound
            parts = {}
            for c, n in sorted(sizes.items()):
                more = min(room, math.ceil(1.3 * n / bound)) if n > bound else 0
                if more:
                    parts[c], room = (len(cents), more + 1), room - more
                    cents = np.vstack([cents, np.repeat(cents[c][None, :], more, axis=0)])
            if not parts:
                break
            moved = materialize(_dealt(moved, parts))
            sizes, tried = _sizes(moved), tried + 1

    number = snap["number"] + 1
    key = f"{COMPACTED}{number}"
    radius, counts = _cell_bounds(moved, len(cents))
    made = CellIndex(moved, cents, radius, counts, index.integer, index.did, index.vec)
    (dealt_by_cell(made).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_cell")
     .parquet(f"{path}/data/batch={key}"))
    # every cell, also empty ones: a cell's number is its place among the centroids
    _cells_frame(made, range(len(cents))).write.mode("overwrite").parquet(f"{path}/cells/batch={key}")
    kept = [b for b in of_batch if b not in small]
    split = {b: sorted({*snap["split"].get(b, []), *over}) for b in kept if over or b in snap["split"]}
    return log.publish(f"snapshots/{number:012d}", {
        "number": number, "live": [b for b in snap["live"] if b in kept] + [key],
        "retired": sorted({*snap["retired"], *small}), "split": split})


def vacuum_index(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that the latest snapshot doesn't count; for when no search of an older state runs."""
    snap = snapshot(spark, path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for folder in ("data", "cells"):
        for status in fs.listStatus(fs_path(f"{path}/{folder}")):
            name = status.getPath().getName()
            key = name.removeprefix("batch=")
            if name.startswith("batch=") and (key in snap["retired"] or key.startswith(COMPACTED) and key not in snap["live"]):
                fs.delete(status.getPath(), True)
                gone.append(f"{folder}/{name}")
    for key, cells in snap["split"].items():
        for c in cells:
            where = fs_path(f"{path}/data/batch={key}/_cell={c}")
            if fs.exists(where):
                fs.delete(where, True)
                gone.append(f"data/batch={key}/_cell={c}")
    return gone
