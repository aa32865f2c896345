"""The corpus pipeline: five stages, each a corpus operator over what the stage before it kept.

``run`` writes every stage's rows as Parquet under ``spark.checkpoint.dir`` and
reads them back as the next stage's documents, so an executor lost later costs
no earlier stage.  No stage can be written in SQL (fitted models, hashes and a
tokenizer), so ``ORACLE_SQL`` is None and the tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askframe.llm import common, mixing, pieces, quality_classifier, simhash, toxicity

STAGES = [
    ("quality", quality_classifier.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.stage),
    ("mixing", mixing.stage),
    ("pieces", pieces.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
