"""Helpers shared by the corpus operators: reading, folds, labelled samples, written tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.session import scratch_path, ship_package

# Rows of one Arrow batch handed to a Python function: whole texts, so a batch stays at a few MB.
BATCH_ROWS = 1000

# ``[^\x20\x09-\x0D]+`` in Java's syntax; in Python, ``bytes.split()`` splits on just these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep Arrow batches of whole texts small."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    The table cuts the lineage: later passes read files that every executor
    sees, so the loss of an executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table of ``written`` that another one has superseded."""
    spark = table.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts(column: pa.Array) -> list[str]:
    """A text column as Python strings: null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [(raw or b"").decode("utf-8", "replace") for raw in column.cast(pa.binary()).to_pylist()]


def typed(keep: str) -> list[Column]:
    """The columns of a schema text (``"doc_id bigint, y int"``), cast to its types."""
    return [F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in keep.split(", "))]


def in_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether ``crc32(doc_id as text) mod modulus = rest`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == rest


def uniform(key: Column, seed: str) -> Column:
    """A hash of ``key`` as a number in [0, 1), the same on every run."""
    salt = int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16)
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: Column,
                    max_rows: int = 12_000, balanced: bool = True) -> DataFrame:
    """(doc_id, text, y, w): about ``max_rows`` labelled rows outside the held-out fold.

    ``max_rows`` bounds what a classifier is fitted on; if ``balanced``, half
    of it goes to each class where there are enough.  Rows are picked by a hash
    of the id.  ``w`` undoes the different sampling rates.  Ids without a 0/1 label take no part;
    an id with two labels counts as its larger one, and of an id's rows the text with the least hash is taken
    (folded per task), so an id with any number of rows is one row of the sample.  The ids go to the scan of
    ``docs`` as a broadcast of at most about ``max_rows`` numbers; only the sample's texts are shuffled.
    """
    rows = (labels.select("doc_id", F.col(target).cast("int").alias("y"))
            .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
            .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    small = min(n.get(0, 0), n.get(1, 0), max_rows // 2)
    share = {y: min(1.0, max(max_rows // 2, max_rows - small) / max(1, n.get(y, 0))) for y in (0, 1)}
    if not balanced:
        share = dict.fromkeys((0, 1), min(1.0, max_rows / max(1, sum(n.values()))))
    rate = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    picked = rows.where(uniform(F.col("doc_id"), "labelled " + target) < rate).select("doc_id", "y", (1 / rate).alias("w"))
    return (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "w")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y", "w"))
