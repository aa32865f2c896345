"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint carries its Hamming distances to reference
fingerprints (the pivots).  By the triangle inequality two fingerprints at
distance r differ by at most r in every such coordinate, so a pair whose
largest coordinate difference exceeds the limit is discarded; survivors are
verified bit by bit.

Which fingerprints meet at all is decided without a cross join: of ``b``
blocks of the 64 bits, two fingerprints that differ in at most r bits agree in
at least ``b - r`` blocks, so they share a key for one choice of ``b - r``
blocks.  ``b`` follows from the number of fingerprints and changes only the
cost, never the result.  Groups leave links to their smallest member, not all
pairs, and components come from alternating star steps over tables.

Defined cases: null, empty and blank texts have fingerprint zero and are one
another's copies; repeated rows give repeated result rows; rows without an id
get a fingerprint and the component of their group (null if no member has an
id); texts of any length are hashed whole, in batches of shingles; a bit set in
exactly half the shingles is 0, and the smallest id names a component, so ties
decide nothing else; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common

SEED = 42
N_PIVOTS = 24
GROUP_ROWS = 2048    # expected fingerprints that share a key
SPLIT_ROWS = 40_000  # a key with more is compared in blocks of about this size

# Reference fingerprints: seeded random words, so any two are about 32 bits apart.
PIVOTS = np.random.default_rng(20_240_601).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)


def fingerprint(raw: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the ``shingle``-word windows of a text (repeats counted), 0 without words."""
    words = raw.lower().split()  # of bytes: A-Z only; splits on \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), ends[len(words) - k:].tolist())),
                    dtype=np.uint64, count=k)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, k, 4096):
        part = h[at:at + 4096].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp): a hash of the text and the fingerprint of every row, as signed 64-bit numbers."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"),
                                              pa.array(np.asarray(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def key_masks(n: int, distance: int, group_rows: int = GROUP_ROWS) -> list[int]:
    """Bit masks of the keys: all choices of ``b - distance`` out of ``b`` blocks, ``b`` by the row count."""
    b = distance + 1
    while b < 16 and n / 2 ** (64 * (b - distance) / b) > group_rows:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [sum(1 << j for j in range(edges[i], edges[i + 1])) for i in range(b)]
    return [sum(c) for c in combinations(blocks, b - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Rows x pivots: Hamming distances of fingerprints to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def linked(group: np.ndarray, fps: np.ndarray, distance: int, table: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first row of its connected part within its group.

    Rows are sorted by (group, first coordinate); step k compares each row with
    the k-th after it while the first coordinates are close enough, drops pairs
    by the other coordinates and verifies the rest.  Memory stays linear.
    """
    n = len(fps)
    table = pivot_table(fps) if table is None else table
    order = np.lexsort((table[:, 0], group))
    g, f, t = group[order], fps[order], table[order]
    label = np.arange(n)
    left, k = np.arange(n - 1), 1
    while len(left):
        left = left[left + k < n]
        right = left + k
        near = (g[left] == g[right]) & (t[right, 0] - t[left, 0] <= distance)
        left, right = left[near], right[near]
        i, j = left, right
        for c in range(1, table.shape[1], 4):  # largest coordinate difference, a few pivots at a time
            if not len(i):
                break
            ok = (np.abs(t[i, c:c + 4] - t[j, c:c + 4]) <= distance).all(axis=1)
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(f[i] ^ f[j]) <= distance
        i, j = i[ok], j[ok]
        fresh = label[i] != label[j]
        if fresh.any():
            for a, b in zip(i[fresh].tolist(), j[fresh].tolist()):
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                label[max(a, b)] = min(a, b)
            while not np.array_equal(label, label[label]):
                label = label[label]
        k += 1
    out = np.empty(n, dtype=np.int64)
    out[order] = order[label]
    return out


def links(fps: DataFrame, distance: int = 4, split_rows: int = SPLIT_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b), b below a: links that connect all distinct ``fp`` at ``distance`` bits or fewer.

    ``pivots`` of ``with_pivots`` come with the fingerprints wherever they meet (computed here if absent).
    """
    fps = fps if "pivots" in fps.columns else with_pivots(fps)
    masks = [_signed(m) for m in key_masks(fps.count(), distance, group_rows)]
    keyed = fps.select("fp", "pivots", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key"))
    hot = (keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > split_rows)
           .select("t", "key", F.ceil(F.col("n") / split_rows).cast("int").alias("parts")))
    # a hot key's rows fall into parts, and each pair of parts (also with itself) is one group
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                      lambda x: F.struct(F.least(x, own).cast("int").alias("i"), F.greatest(x, own).cast("int").alias("j")))
    cells = keyed.join(hot, ["t", "key"], "left").select(
        "fp", "pivots", "t", "key", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
                                    .otherwise(met)).alias("cell"))
    rows = (cells.select("t", "key", "cell.i", "cell.j", "fp", "pivots").repartition("t", "key", "i", "j")
            .sortWithinPartitions("t", "key", "i", "j"))
    names = ["t", "key", "i", "j"]

    def solve(batch: pa.RecordBatch):
        cols = [batch.column(c).to_numpy() for c in names]
        fp = batch.column("fp").to_numpy()
        new = np.zeros(len(fp), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        table = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), dtype=np.int8).reshape(-1, N_PIVOTS)
        first = linked(np.cumsum(new), fp.view(np.uint64), distance, table)
        a, b = fp, fp[first]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[a != b]), pa.array(np.minimum(a, b)[a != b])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # whole groups only: the last one may go on in the next batch
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 50_000:
                continue
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = _last_group(joined, names)
            if cut:
                yield solve(joined.slice(0, cut))
            held, size = [joined.slice(cut)], joined.num_rows - cut
        if size:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _last_group(batch: pa.RecordBatch, names: list[str]) -> int:
    """Index of the first row of the batch's last group."""
    same = np.ones(batch.num_rows, dtype=bool)
    for c in names:
        x = batch.column(c).to_numpy()
        same &= x == x[-1]
    return int(np.argmax(same))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest member of each linked node's component.

    Alternating large-star and small-star steps; each is a partial minimum per
    node and a join back, written to the shared folder before the next.  A node
    outside every edge has no row.
    """
    edges = common.written(edges.select("a", "b"), "links")
    seen = None
    while True:
        last = edges
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        edges = common.written(small, "links")
        common.forget(last)  # superseded
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(now) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)


def with_pivots(fps: DataFrame) -> DataFrame:
    """``fp`` with ``pivots``: its distances to the reference fingerprints, a byte each."""
    def run(batches):
        for batch in batches:
            table = pivot_table(batch.column("fp").to_numpy().view(np.uint64)).view(f"S{N_PIVOTS}").ravel()
            rows = [x.ljust(N_PIVOTS, b"\0") for x in table.tolist()]  # numpy drops zeros at the end
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(rows, pa.binary())], ["fp", "pivots"])

    return fps.mapInArrow(run, "fp bigint, pivots binary")


def grouped(docs: DataFrame, distance: int = 4, shingle: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) and, per distinct fp, (fp, root, first).

    ``root`` names the component, ``first`` its least (unnamed, doc_id, h): a
    row with an id comes before every row without one.
    """
    rows = common.written(fingerprints(docs, shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")
    distinct = common.written(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    roots = components(links(common.written(with_pivots(distinct.select("fp")), "pivots"), distance))
    # only linked fingerprints need their component's least row; sides written apart, so that Spark can split hot keys
    nodes = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = common.written(nodes.join(distinct, "fp"), "linked")
    least = common.written(linked.groupBy("root").agg(F.min("first").alias("least")), "smallest")
    found = linked.join(least, "root").select("fp", "root", "least")
    of = common.written(distinct.join(found, "fp", "left")
                        .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("first")), "components-of")
    return rows, of


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is its smallest reachable doc_id."""
    rows, of = grouped(docs, distance, shingle)
    return rows.join(of, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint (16 hex digits), component_id."""
    common.ready(spark)
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, the smallest by (id, nulls last; hash of the text), columns as they were.

    Rows that share an id but not the text are told apart; of equal rows one
    stays, with an id or without.  Texts move once, to meet the keys kept.
    """
    common.ready(spark)
    _, of = grouped(docs)
    kept = of.select(F.col("first.unnamed").alias("__u"), F.coalesce("first.doc_id", F.lit(0)).alias("__id"),
                     F.col("first.h").alias("__h")).distinct()
    own = F.col("doc_id").cast("bigint")
    rows = (docs.withColumn("__u", own.isNull()).withColumn("__id", F.coalesce(own, F.lit(0))).withColumn("__h", F.xxhash64("text")))
    return rows.join(kept, ["__u", "__id", "__h"], "left_semi").dropDuplicates(["__u", "__id", "__h"]).select(*docs.columns)
