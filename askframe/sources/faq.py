"""Nested FAQ documents: ``categories[].{category, questions[].{question, answer}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe import rules
from askframe.functions.text import fix_encoding
from askframe.operators.kb import assign_dense_ids
from askframe.session import few_listing_tasks

QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
CATEGORY = T.StructType([T.StructField("category", T.StringType()),
                         T.StructField("questions", T.ArrayType(QA))])
FAQ_SCHEMA = T.StructType([T.StructField("categories", T.ArrayType(CATEGORY))])


def read_faq_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file with an explicit schema (no inference pass); ``file`` is its whole path."""
    with few_listing_tasks(spark):
        faq = spark.read.schema(FAQ_SCHEMA).option("multiLine", True).json(path)
    return (faq.withColumn("file", F.input_file_name())
               .withColumn("source", F.element_at(F.split("file", "/"), -1)))


def flatten_faq(faq: DataFrame, file_no_col: str | None = None, source_col: str = "source",
                src_no: int = 1) -> DataFrame:
    """Raw Q/A rows in document order; rows missing a question or an answer are dropped.

    A missing (null) category becomes ``General``.  ``posexplode`` keeps the
    array positions, which become ``seq``; ``seq.sheet_no`` orders the files, by
    ``file_no_col`` or, for files read by ``read_faq_json``, by their path.
    """
    if file_no_col:
        file_no = F.col(file_no_col).cast("long")
    elif "file" in faq.columns:
        numbered = assign_dense_ids(faq.select("file").distinct(), ["file"], "_file_no")
        faq, file_no = faq.join(numbered, "file"), F.col("_file_no")
    else:
        file_no = F.lit(0).cast("long")
    cats = faq.select(file_no.alias("_file"), F.col(source_col).alias("_source"),
                      F.posexplode("categories").alias("_cpos", "_cat"))
    qas = cats.select("_file", "_source", "_cpos",
                      F.coalesce(F.col("_cat.category"), F.lit(rules.DEFAULT_CATEGORY)).alias("_category"),
                      F.posexplode("_cat.questions").alias("_qpos", "_qa"))
    out = qas.select(
        fix_encoding(F.col("_category")).alias("category"), F.col("_source").alias("source"),
        fix_encoding(F.col("_category")).alias("source_sheet"),
        fix_encoding(F.col("_qa.question")).alias("question"),
        fix_encoding(F.col("_qa.answer")).alias("answer"),
        F.struct(F.lit(src_no).alias("src_no"), F.col("_file").alias("sheet_no"),
                 (F.col("_cpos").cast("long") * F.lit(1 << 32) + F.col("_qpos")).alias("pos")).alias("seq"))
    return out.filter((F.col("question") != "") & (F.col("answer") != ""))
