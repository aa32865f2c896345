"""End-to-end jobs: build the KB and its vectors, answer questions, evaluate retrieval.

Each job reads its inputs from (shared) storage, runs as Spark jobs and writes
its outputs; the driver only holds parameters, a few counts and bounded
centroid arrays.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe import rules
from askframe.operators import evaluate as EV
from askframe.operators import kb as K
from askframe.operators.answer import answer_questions
from askframe.operators.util import release, sweep
from askframe.operators.vectors import (build_vector_index, index_exists, kb_vectors, load_vector_index, load_vectors,
                                       stored_index_exists, write_vectors)
from askframe.sources.faq import flatten_faq, read_faq_json
from askframe.sources.kb_store import has_rows, load_knowledge_base, path_exists, write_knowledge_base
from askframe.sources.sheets import parse_sheets
from askframe.sources.units import process_changes

log = logging.getLogger(__name__)


def build_knowledge_base(spark: SparkSession, *, kb_path: str, vectors_path: str | None = None,
                         index_path: str | None = None,
                         sheet_rows_path: str | None = None, sheet_map_path: str | None = None,
                         faq_path: str | None = None, workbook_name: str = "workbook.xlsx",
                         skip_sheets: list[str] | None = None, rebuild: bool = False,
                         profile: rules.Profile = rules.DEFAULT_PROFILE,
                         embedder: Callable[[Column], Column] | None = None, units_path: str | None = None) -> DataFrame:
    """Sheets first, then the FAQ; redact, drop blank answers, keep first, number, write.

    Without ``rebuild`` an existing, non-empty KB is kept as it is, uploads
    included; vectors or a cell index that are missing are built from it.  A
    missing source is logged and skipped.  Paths may be globs.  With
    ``units_path`` a build processes only the sheets and files that changed
    since the builds before (``sources.units``); its result is that of a full one.
    """
    if not rebuild and has_rows(spark, kb_path):
        log.info("knowledge base already exists at %s; pass rebuild=True to rebuild", kb_path)
        kb = load_knowledge_base(spark, kb_path)
        if vectors_path and not index_exists(spark, vectors_path):
            write_vectors(kb_vectors(kb, embedder), vectors_path)
        if vectors_path and index_path and not stored_index_exists(spark, index_path):
            build_vector_index(load_vectors(spark, vectors_path), index_path)
        return kb

    sheet_rows = sheet_map = faq = None
    if sheet_rows_path and path_exists(spark, sheet_rows_path):
        sheet_rows = spark.read.parquet(sheet_rows_path)
        if sheet_map_path and path_exists(spark, sheet_map_path):
            sheet_map = spark.read.parquet(sheet_map_path)
    elif sheet_rows_path:
        log.warning("sheet rows not found: %s", sheet_rows_path)
    if faq_path and path_exists(spark, faq_path):
        faq = faq_path
    elif faq_path:
        log.warning("FAQ not found: %s", faq_path)
    if sheet_rows is None and faq is None:
        raise ValueError("no source found; nothing to build")

    if units_path:
        kept, n = process_changes(spark, units_path, sheet_rows, sheet_map, faq, workbook_name, skip_sheets, profile)
        log.info("%d sheets or files processed", n)
        kb = K.fold(kept)
    else:
        parts = []
        if sheet_rows is not None:
            parts.append(parse_sheets(sheet_rows, sheet_map, skip_sheets, source=workbook_name, src_no=0))
        if faq is not None:
            parts.append(flatten_faq(read_faq_json(spark, faq), src_no=1))
        raw = parts[0]
        for p in parts[1:]:
            raw = raw.unionByName(p)
        kb = K.process_documents(raw, profile)
    write_knowledge_base(kb, kb_path)
    release(kb)
    kb = kept = raw = parts = None  # what the build shuffled and stored on the way may go
    sweep(spark)
    kb = load_knowledge_base(spark, kb_path)
    if vectors_path:
        write_vectors(kb_vectors(kb, embedder), vectors_path)
        if index_path:
            build_vector_index(load_vectors(spark, vectors_path), index_path)
    return kb


def answer_job(spark: SparkSession, questions: DataFrame, vectors_path: str | None = None,
               out_path: str | None = None, index_path: str | None = None, **kw) -> DataFrame:
    """Answer a table of ``(query_id, query)`` from a vector table or a stored cell index."""
    vectors = load_vectors(spark, vectors_path) if vectors_path else None
    index = load_vector_index(spark, index_path) if index_path else None
    answered = answer_questions(questions.select("query_id", "query"), vectors, index=index, **kw)
    if out_path:
        answered.withColumn("n_sources", F.size("sources")).write.mode("overwrite").parquet(out_path)
        return spark.read.parquet(out_path).drop("n_sources")  # a later action doesn't generate again
    return answered


def evaluate_job(spark: SparkSession, kb_path: str, vectors_path: str | None = None, ks: list[int] | None = None,
                 limit: int | None = None, index_path: str | None = None,
                 embedder: Callable[[Column], Column] | None = None, **search) -> DataFrame:
    """Hit rates by k against a vector table or a stored cell index; ``embedder`` is the one that built it."""
    kb = load_knowledge_base(spark, kb_path)
    vectors = load_vectors(spark, vectors_path) if vectors_path else None
    index = load_vector_index(spark, index_path) if index_path else None
    return EV.hit_rates_by_k(kb, vectors, ks or rules.EVAL_KS, limit=limit, index=index, embedder=embedder, **search)
