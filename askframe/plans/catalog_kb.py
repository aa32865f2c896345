"""Registered queries: knowledge-base build, ids, unions, uploads, breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe import rules
from askframe.functions.text import after_first_line, doc_text, first_line
from askframe.operators import kb as K
from askframe.plans import inputs as I
from askframe.plans import sqltext as Q
from askframe.plans.registry import register
from askframe.plans.tables import table
from askframe.sources.uploads import decode_uploads


def kb_raw(spark, d):
    """Both sources, sheets (conversations) first, then the FAQ-like documents."""
    return I.conv_qa(spark, d).unionByName(I.docs_raw(spark, d))


def kb_table(spark, d):
    return K.process_documents(kb_raw(spark, d))


def _kb_sql(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    return I.with_(I.kb_ctes() + (extra or []), body)


def _docs_only_ctes() -> list[tuple[str, str]]:
    ctes = []
    for name, sql in I.kb_ctes():
        if name == "raw_union":
            sql = "SELECT * FROM docs_raw"
        ctes.append((name, sql))
    return [c for c in ctes if c[0] != "conv_qa"]


# --------------------------------------------------------------------------- P6
_KB_TEXT_Q = f"CASE WHEN doc_id % 3 = 0 THEN '' ELSE {Q.first_line('text')} END"


@register("kb_text", f"SELECT doc_id, {Q.doc_text('source', _KB_TEXT_Q, Q.after_first_line('text'))} AS text "
                     f"FROM documents")
def kb_text(spark, d):
    docs = table(spark, d, "documents")
    q = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(first_line("text"))
    return docs.select("doc_id", doc_text(F.col("source"), q, after_first_line("text")).alias("text"))


# --------------------------------------------------------------------------- W1
@register("kb_dedup_first", I.with_(_docs_only_ctes(),
                                    "SELECT category, question, answer, pos FROM firsts"))
def kb_dedup_first(spark, d):
    kept = K.redact_and_filter(I.docs_raw(spark, d))
    from askframe.functions.text import dedup_question_key
    first = K.dedup_keep_first(kept, dedup_question_key("category", "question"), ["seq"])
    return first.select("category", "question", "answer", F.col("seq.pos").alias("pos"))


# --------------------------------------------------------------------------- W2
@register("kb_assign_ids", I.with_(_docs_only_ctes(), "SELECT id, ord, question FROM kb"))
def kb_assign_ids(spark, d):
    kb = K.process_documents(I.docs_raw(spark, d))
    return kb.select("id", "ord", "question")


# --------------------------------------------------------------------------- U1
@register("kb_union_sources", I.with_(I.kb_ctes()[:3], (
    "SELECT CAST(src_no AS INTEGER) AS src_no, sheet_no, pos, category, source, source_sheet, question, answer "
    "FROM raw_union")))
def kb_union_sources(spark, d):
    raw = kb_raw(spark, d)
    return raw.select(F.col("seq.src_no").cast("int").alias("src_no"), F.col("seq.sheet_no").alias("sheet_no"),
                      F.col("seq.pos").alias("pos"), "category", "source", "source_sheet", "question", "answer")


# --------------------------------------------------------------------------- X3 / K1
@register("kb_build", _kb_sql("SELECT id, category, source, source_sheet, question, answer, text, ord FROM kb"))
def kb_build(spark, d):
    return kb_table(spark, d)


# --------------------------------------------------------------------------- K2 / P7
_UPLOAD_CLEAN = Q.redact_ingest(Q.fix("text"))


@register("kb_append_upload", _kb_sql(
    f"SELECT {Q.doc_id('ord')} AS id, category, '{rules.UPLOAD_SOURCE}' AS source, category AS source_sheet, "
    f"'' AS question, answer, 'Product: ' || category || chr(10) || answer AS text, ord FROM ("
    f"SELECT source AS category, {_UPLOAD_CLEAN} AS answer, "
    f"(SELECT count(*) FROM kb) + row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)"))
def kb_append_upload(spark, d):
    kb = kb_table(spark, d)
    docs = table(spark, d, "documents")
    uploads = docs.select("text", F.col("source").alias("category"),
                          F.struct(F.lit(2).alias("src_no"), F.lit(0).cast("long").alias("sheet_no"),
                                   F.col("doc_id").cast("long").alias("pos")).alias("seq"))
    return K.append_uploads(kb, uploads)


# --------------------------------------------------------------------------- A2 / O1
@register("kb_category_breakdown", _kb_sql(
    "SELECT category, count(*) AS n, grouping(category) = 1 AS is_total FROM kb GROUP BY ROLLUP (category)"))
def kb_category_breakdown(spark, d):
    return K.category_breakdown(kb_table(spark, d))


# --------------------------------------------------------------------------- A3
@register("kb_source_counts", _kb_sql("SELECT source, source_sheet, count(*) AS n FROM kb GROUP BY ALL"))
def kb_source_counts(spark, d):
    return K.source_counts(kb_table(spark, d))


# --------------------------------------------------------------------------- S4 / S5
@register("upload_decode", (
    "SELECT 'event_' || CAST(event_id AS VARCHAR) AS upload_id, 'json' AS kind, "
    "CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN CAST(json(props) AS VARCHAR) "
    "ELSE props END AS text FROM events "
    "UNION ALL SELECT 'page_' || CAST(page_id AS VARCHAR), 'txt', html FROM pages"))
def upload_decode(spark, d):
    ev = table(spark, d, "events").select(
        F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("upload_id"),
        F.lit("json").alias("kind"), F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        F.col("props").cast("binary").alias("content"))
    pg = table(spark, d, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("upload_id"),
        F.lit("txt").alias("kind"), F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("html").cast("binary").alias("content"))
    out = decode_uploads(ev.unionByName(pg))
    return out.select("upload_id", "kind", "text")
