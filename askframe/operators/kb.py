"""Knowledge-base shaping: keep-first dedup, dense ordered ids, the build job, breakdowns.

Row order matters for the results (first copy wins, ids follow source order),
and Spark rows carry no order, so every input carries an explicit ``seq``
struct ``(src_no, sheet_no, pos)`` and every operator here orders by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe import rules
from askframe.functions.pii import redact_ingest
from askframe.functions.text import dedup_question_key, doc_id, doc_text, py_strip
from askframe.operators.util import materialize, release

KB_COLUMNS = ["id", "category", "source", "source_sheet", "question", "answer", "text", "ord"]
RAW_COLUMNS = ["category", "source", "source_sheet", "question", "answer", "seq"]


def dedup_keep_first(df: DataFrame, key: Column | str, order_cols: list[str]) -> DataFrame:
    """Keep the row with the smallest ``order_cols`` per key.

    A hash aggregate with ``min_by`` rather than a ranking window: the partial
    (map-side) aggregate folds a hot key to one row per task before the
    shuffle, so a key holding a third of all rows costs no more than any other.
    """
    key_col = F.col(key) if isinstance(key, str) else key
    payload = [c for c in df.columns]
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(key_col.alias("_dedup_key"))
              .agg(F.min_by(F.struct(*[F.col(c) for c in payload]), order).alias("_first"))
              .select("_first.*"))


def assign_dense_ids(df: DataFrame, order_cols: list[str], out: str = "ord",
                     start: int | Column = 0, partitions: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order_cols`` order, without a global window.

    Range-partition and sort by the order, checkpoint (to the shared folder, so
    partition contents are fixed and survive executor loss), count rows per
    partition (one number per partition reaches the driver), then add the
    partition's offset (a row of a small table) to the row's index inside it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range sampler and the shuffle would each evaluate ``df``: both read a checkpoint in the shared folder.
    given = materialize(df)
    ordered = materialize(given.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    release(given)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    counts = dict(tagged.groupBy("_pid").count().collect())
    offsets, acc = [], 0
    for p in sorted(counts):
        offsets.append((p, acc))
        acc += counts[p]
    table = spark.createDataFrame(offsets, "_pid int, _offset long")  # at most a row per partition
    start_col = start if isinstance(start, Column) else F.lit(start).cast("long")
    return (tagged.join(F.broadcast(table), "_pid")
            .select(*df.columns, (F.col("_offset") + F.col("_at") + start_col).alias(out)))


def redact_and_filter(raw: DataFrame, profile: rules.Profile = rules.DEFAULT_PROFILE) -> DataFrame:
    """Redact question and answer, drop rows whose answer is blank afterwards.

    Every redaction replaces a match that contains digits by a non-empty label,
    so an answer is blank after redaction exactly when it was blank before; the
    filter therefore runs first, on the raw text.  (Filtering on the redacted
    column would be pushed below the projection by Catalyst and evaluate the
    regex chain twice.)
    """
    return (raw.filter(py_strip(F.coalesce("answer", F.lit(""))) != "")
               .withColumn("question", redact_ingest(F.coalesce("question", F.lit("")), profile))
               .withColumn("answer", redact_ingest(F.coalesce("answer", F.lit("")), profile)))


def finish_kb(first: DataFrame, start: int | Column = 0) -> DataFrame:
    ided = assign_dense_ids(first, ["seq"], "ord", start=start)
    return ided.select(doc_id(F.col("ord")).alias("id"), "category", "source", "source_sheet",
                       "question", "answer",
                       doc_text("category", "question", "answer").alias("text"), "ord")


def process_documents(raw: DataFrame, profile: rules.Profile = rules.DEFAULT_PROFILE) -> DataFrame:
    """Raw Q/A rows (``RAW_COLUMNS``) to knowledge-base rows (``KB_COLUMNS``)."""
    return fold(redact_and_filter(raw.select(*RAW_COLUMNS), profile))


def fold(kept: DataFrame) -> DataFrame:
    """Redacted rows to knowledge-base rows: the first of each key, numbered."""
    first = dedup_keep_first(kept, dedup_question_key("category", "question"), ["seq"])
    return finish_kb(first)


def category_breakdown(kb: DataFrame) -> DataFrame:
    """Rows per category plus a total row (``is_total``), largest first."""
    agg = (kb.rollup("category").agg(F.count(F.lit(1)).alias("n"),
                                     F.grouping("category").alias("_g")))
    return (agg.select(F.col("category"), F.col("n"), (F.col("_g") == 1).alias("is_total"))
               .orderBy(F.col("is_total"), F.desc("n"), F.col("category")))


def source_counts(kb: DataFrame) -> DataFrame:
    return kb.groupBy("source", "source_sheet").agg(F.count(F.lit(1)).alias("n"))


def upload_rows(uploads: DataFrame, profile: rules.Profile = rules.DEFAULT_PROFILE) -> DataFrame:
    """Uploaded texts (``text``, ``category``, ``seq``) to raw KB rows: cleaned, redacted, no question."""
    from askframe.functions.text import fix_encoding
    cleaned = redact_ingest(fix_encoding("text"), profile)
    return uploads.select(F.col("category"), F.lit(rules.UPLOAD_SOURCE).alias("source"),
                          F.col("category").alias("source_sheet"), F.lit("").alias("question"),
                          cleaned.alias("answer"), F.col("seq"))


def append_uploads(kb: DataFrame | int, uploads: DataFrame,
                   profile: rules.Profile = rules.DEFAULT_PROFILE) -> DataFrame:
    """New KB rows for a batch of uploads; ids continue after the current KB (a table, or the first number itself).

    Uploads are neither deduplicated nor filtered for blank text, as in the
    one-at-a-time flow being rebuilt.
    """
    base = kb if isinstance(kb, int) else kb.count()
    rows = upload_rows(uploads, profile)
    ided = assign_dense_ids(rows, ["seq"], "ord", start=base)
    return ided.select(doc_id(F.col("ord")).alias("id"), "category", "source", "source_sheet",
                       "question", "answer",
                       F.concat(F.lit("Product: "), F.col("category"), F.lit("\n"), F.col("answer")).alias("text"),
                       "ord")
