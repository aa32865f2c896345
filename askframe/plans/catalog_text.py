"""Registered queries: text repair, cells, pairing, redaction, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe import rules
from askframe.functions import guard as G
from askframe.functions.pii import redact_ingest
from askframe.functions.text import fix_encoding, row_to_text
from askframe.plans import inputs as I
from askframe.plans import sqltext as Q
from askframe.plans.registry import register
from askframe.plans.tables import table
from askframe.sources.faq import flatten_faq
from askframe.sources.sheets import sheet_products

# --------------------------------------------------------------------------- P1
_MOJIBAKE_SQL = (f"SELECT doc_id, {Q.fix('t')} AS text FROM "
                 f"(SELECT doc_id, {I.sql_seed(I.MOJIBAKE_SEED)} AS t FROM documents)")


@register("clean_mojibake", _MOJIBAKE_SQL)
def clean_mojibake(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    seeded = docs.select("doc_id", I.spark_seed(I.MOJIBAKE_SEED).alias("t"))
    return seeded.select("doc_id", fix_encoding("t").alias("text"))


# --------------------------------------------------------------------------- P4, P5
_CELLS_SQL = I.with_([
    ("lines", "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT doc_id, "
              "unnest(string_split(text, chr(10))) AS line, "
              "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"),
], f"SELECT doc_id, line_no, {Q.row_to_text('cells')} AS row_text FROM ("
   f"SELECT doc_id, line_no, list_concat([{I.sql_seed(I.CELL_SEED)}], string_split(line, ',')) AS cells FROM lines)")


@register("clean_cells", _CELLS_SQL)
def clean_cells(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line")
    cells = lines.select("doc_id", "line_no",
                         F.concat(F.array(I.spark_seed(I.CELL_SEED)), F.split("line", ",", -1)).alias("cells"))
    return cells.select("doc_id", "line_no", row_to_text("cells").alias("row_text"))


# --------------------------------------------------------------------------- S2 / A1 / W3
@register("qa_extract", I.with_([("q", I.CONV_QA_SQL)],
                                "SELECT source_sheet AS sheet, pos, question, answer FROM q"))
def qa_extract(spark, d):
    qa = I.conv_qa(spark, d)
    return qa.select(F.col("source_sheet").alias("sheet"), F.col("seq.pos").alias("pos"), "question", "answer")


# --------------------------------------------------------------------------- S1 / P19
# Every block of 50 turns of a conversation is one FAQ file with one category object
# (category missing for every tenth conversation -> "General"); a question is a user
# turn, its answer the text of the next turn number.  Files stay bounded (<= 50 entries)
# however long a conversation is; the next turn is found by an equi-join, not a window.
FAQ_BLOCK = 50
FILE_STRIDE = 1_000_000

_FAQ_CAT = Q.fix("coalesce(category, 'General')")
_FAQ_SQL = (
    f"SELECT {_FAQ_CAT} AS category, 'conv_' || CAST(conv_id AS VARCHAR) AS source, "
    f"{Q.fix('question')} AS question, {Q.fix('answer')} AS answer, CAST(conv_id AS BIGINT) AS file_no, "
    f"CAST(cpos AS BIGINT) AS cpos, CAST(qpos AS BIGINT) AS qpos FROM ("
    f"SELECT c.conv_id, c.turn // {FAQ_BLOCK} AS cpos, "
    f"row_number() OVER (PARTITION BY c.conv_id, c.turn // {FAQ_BLOCK} ORDER BY c.turn) - 1 AS qpos, "
    f"CASE WHEN c.conv_id % 10 = 0 THEN NULL ELSE 'Topic ' || CAST(c.conv_id % 17 AS VARCHAR) END AS category, "
    f"c.text AS question, n.text AS answer FROM conversations c LEFT JOIN conversations n "
    f"ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.role = 'user') "
    f"WHERE {Q.fix('question')} <> '' AND {Q.fix('answer')} <> ''")


@register("kb_flatten_faq", _FAQ_SQL)
def kb_flatten_faq(spark, d):
    conv = table(spark, d, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = (conv.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
                 .withColumn("cpos", F.floor(F.col("turn") / FAQ_BLOCK).cast("long")))
    cat = F.when(F.col("conv_id") % 10 == 0, F.lit(None).cast("string")) \
           .otherwise(F.concat(F.lit("Topic "), (F.col("conv_id") % 17).cast("string")))
    files = (pairs.groupBy("conv_id", "cpos")
             .agg(F.first(cat).alias("category"),
                  F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("question"), "answer")))
                  .alias("qs"))
             .select((F.col("conv_id") * FILE_STRIDE + F.col("cpos")).alias("file_no"),
                     F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source"),
                     F.array(F.struct("category", F.transform(
                         "qs", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer")))
                         .alias("questions"))).alias("categories")))
    flat = flatten_faq(files, file_no_col="file_no", source_col="source")
    return flat.select("category", "source", "question", "answer",
                       F.floor(F.col("seq.sheet_no") / FILE_STRIDE).cast("long").alias("file_no"),
                       (F.col("seq.sheet_no") % FILE_STRIDE).cast("long").alias("cpos"),
                       F.col("seq.pos").bitwiseAND(F.lit(0xFFFFFFFF)).alias("qpos"))


# --------------------------------------------------------------------------- J1 / F7
_MAP_RULE = "CAST(substr(source, 4) AS INTEGER) % 2 = 0"
SKIPPED_CODES = ["src3", "src7"]


@register("kb_source_map", (
    f"WITH m AS (SELECT DISTINCT source AS sheet, 'Product ' || upper(source) AS product FROM documents "
    f"WHERE {_MAP_RULE}) SELECT d.doc_id, d.source AS sheet, coalesce(m.product, {Q.strip('d.source')}) AS product "
    f"FROM documents d LEFT JOIN m ON d.source = m.sheet "
    f"WHERE d.source NOT IN ({', '.join(Q.lit(s) for s in SKIPPED_CODES)})"))
def kb_source_map(spark, d):
    docs = table(spark, d, "documents")
    sheet_map = (docs.filter(F.expr(_MAP_RULE)).select(F.col("source").alias("sheet")).distinct()
                     .withColumn("product", F.concat(F.lit("Product "), F.upper("sheet"))))
    rows = docs.select("doc_id", F.col("source").alias("sheet"))
    out = sheet_products(rows, sheet_map, SKIPPED_CODES)
    return out.select("doc_id", "sheet", "product")


# --------------------------------------------------------------------------- P2
@register("pii_redact", f"SELECT doc_id, {Q.redact_ingest('t')} AS text FROM "
                        f"(SELECT doc_id, {I.sql_seed(I.PII_SEED)} AS t FROM documents)")
def pii_redact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    seeded = docs.select("doc_id", I.spark_seed(I.PII_SEED).alias("t"))
    return seeded.select("doc_id", redact_ingest("t").alias("text"))


# --------------------------------------------------------------------------- F1 / P10
_GUARD_SQL = I.with_([("qs", I.QUESTIONS_SQL), ("r", f"SELECT query_id, query, {Q.guard_reason('query')} AS reason FROM qs")], (
    f"SELECT query_id, reason = '' AS allowed, reason, {Q.guard_message('reason')} AS safe_message, "
    f"CASE WHEN reason = '' AND {Q.input_pii('query')} THEN {Q.lit(rules.MSG_PII_WARNING)} ELSE '' END AS warning "
    f"FROM r"))


@register("guard_input", _GUARD_SQL)
def guard_input(spark, d):
    qs = I.questions(spark, d)
    return qs.select("query_id", G.guard_input(F.col("query")).alias("g")).select("query_id", "g.*")


# --------------------------------------------------------------------------- F2
@register("topic_keyword_match", I.with_([("qs", I.QUESTIONS_SQL)],
                                         f"SELECT query_id, {Q.keyword_match('query')} AS has_keyword FROM qs"))
def topic_keyword_match(spark, d):
    qs = I.questions(spark, d)
    return qs.select("query_id", G.keyword_match(F.col("query")).alias("has_keyword"))


# --------------------------------------------------------------------------- P11 / P12
_OUT_SQL = I.with_([("a", I.ANSWERS_SQL)], (
    f"SELECT query_id, CASE WHEN {Q.sanitize_output('raw')} <> coalesce(raw, '') THEN "
    f"{Q.lit(rules.REASON_SANITIZED)} ELSE '' END AS reason, {Q.sanitize_output('raw')} AS safe_message, "
    f"{Q.final_answer('raw')} AS answer FROM a"))


@register("guard_output", _OUT_SQL)
def guard_output(spark, d):
    ans = I.answers(spark, d)
    chk = G.check_output(F.col("raw"))
    return ans.select("query_id", chk["reason"].alias("reason"), chk["safe_message"].alias("safe_message"),
                      G.final_answer(F.col("raw")).alias("answer"))
