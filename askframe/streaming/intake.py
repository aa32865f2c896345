"""Structured Streaming jobs.

* ``start_upload_intake``: new ``.txt``/``.json`` files under a folder become
  cleaned, redacted KB rows (ids continue after the current KB size) plus their
  vectors, appended per micro-batch.
* ``start_question_answering``: question files (parquet) are answered per
  micro-batch with the batch flow against a static vector table.

Both run ``foreachBatch`` with a checkpoint, so a restarted query resumes where
it stopped.  A micro-batch is known by its stream (the checkpoint folder) and
its number: several streams may write to one KB.  Its rows go to a folder of
that key, whose committed writes a replay skips, completing what is missing.
The KB is written before the vectors, the vectors before the stored index.

Uploads are many small files, and Spark's settings for them are those of the
session that a stream was loaded with, read anew for every batch.  The intake
therefore runs in a session of its own (``packing_session``) with two changes:

* Spark packs files into tasks by bytes and adds
  ``spark.sql.files.openCostInBytes`` (4 MB) for each, so 10,000 small files
  become hundreds of tasks of 32 files however few cores there are; here a file
  counts ``OPEN_COST`` more, so tasks get groups of files balanced by bytes, as
  many groups as there are cores or more;
* the files of a batch are looked up by a job of up to 10,000 tasks, one per
  file; here it has ``LISTING_TASKS``, or four for each core if that is more.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe import rules
from askframe.operators.answer import answer_questions
from askframe.session import LISTING_KEY, LISTING_TASKS, listing_tasks  # noqa: F401
from askframe.sources.kb_store import append_batch, batch_written, stream_key, write_batch
from askframe.sources.uploads import UPLOAD_GLOB, category_from_path, decode_uploads

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


OPEN_COST, OPEN_COST_KEY = 64 * 1024, "spark.sql.files.openCostInBytes"


def packing_session(spark: SparkSession, open_cost: int = OPEN_COST) -> SparkSession:
    """A session like ``spark``, with its settings, functions and views, that packs small files into tasks."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(OPEN_COST_KEY, str(open_cost))
    own.conf.set(LISTING_KEY, str(listing_tasks(spark)))
    return own


@contextmanager
def packed_files(spark: SparkSession, open_cost: int = OPEN_COST):
    """Batch actions inside plan their file groups with this cost per file; for streams see ``packing_session``."""
    old = spark.conf.get(OPEN_COST_KEY)
    spark.conf.set(OPEN_COST_KEY, str(open_cost))
    try:
        yield
    finally:
        spark.conf.set(OPEN_COST_KEY, old)


def start_upload_intake(spark: SparkSession, source_dir: str, kb_path: str, vectors_path: str,
                        checkpoint: str, profile: rules.Profile = rules.DEFAULT_PROFILE,
                        embedder: Callable[[Column], Column] | None = None, available_now: bool = True,
                        index_path: str | None = None, max_files_per_trigger: int | None = None):
    """The running query.  It belongs to a session of its own, so ``spark.streams`` doesn't list it: keep the handle."""
    reader = (packing_session(spark).readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
                   .option("pathGlobFilter", UPLOAD_GLOB).option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    decoded = decode_uploads(reader.load(source_dir)).withColumn("category", category_from_path())

    def write(batch: DataFrame, batch_id: int) -> None:
        uploads = batch.select("text", "category",
                               F.struct(F.lit(3).alias("src_no"), F.lit(batch_id).cast("long").alias("sheet_no"),
                                        F.col("path").alias("pos")).alias("seq"))
        append_batch(batch.sparkSession, kb_path, uploads, stream_key(checkpoint, batch_id), profile, vectors_path,
                     embedder, index_path)

    writer = decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_question_answering(spark: SparkSession, source_dir: str, schema: str, vectors: DataFrame | None,
                             out_path: str, checkpoint: str, available_now: bool = True,
                             max_files_per_trigger: int | None = None, **answer_kw):
    """Answers question files per micro-batch; pass ``index=`` to search a stored index instead of clustering
    ``vectors`` again in every batch."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        key = stream_key(checkpoint, batch_id)
        if batch_written(batch.sparkSession, out_path, key):
            return
        answered = answer_questions(batch.select("query_id", "query"), vectors, **answer_kw)
        write_batch(answered.withColumn("n_sources", F.size("sources")).drop("sources"), out_path, key)

    writer = reader.parquet(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
