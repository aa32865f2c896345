"""Behaviours kept on purpose."""

from pyspark.sql import functions as F

from askframe.operators import kb as K
from askframe.operators.answer import answer_questions
from askframe.operators.similarity import similarity_topk
from askframe.operators.vectors import kb_vectors
from askframe.sources.sheets import parse_sheets


def test_q9_preamble_beats_later_what_is_question(spark):
    rows = [("P", 0, 0, ["Intro about P."]), ("P", 0, 1, ["First?"]), ("P", 0, 2, ["One."]),
            ("P", 0, 3, ["What is P?"]), ("P", 0, 4, ["Real answer."])]
    raw = parse_sheets(spark.createDataFrame(rows, "sheet string, sheet_no int, row_no long, cells array<string>"))
    kb = K.process_documents(raw).orderBy("ord").collect()
    assert [(r.question, r.answer) for r in kb] == [("What is P?", "Intro about P."), ("First?", "One.")]


def test_q10_uploads_not_deduplicated_and_rebuild_overwrites(spark, tmp_path):
    from askframe.sources.kb_store import append_uploads_to, load_knowledge_base, write_knowledge_base
    path = str(tmp_path / "kb")
    base = _raw_kb(spark)
    write_knowledge_base(base, path)
    up = spark.createDataFrame([("same", "C", 0), ("same", "C", 1)], "text string, category string, pos long") \
        .selectExpr("text", "category", "named_struct('src_no', 2, 'pos', pos) AS seq")
    append_uploads_to(spark, path, up)
    assert load_knowledge_base(spark, path).filter(F.col("answer") == "same").count() == 2
    write_knowledge_base(base, path)             # a rebuild: uploads are gone
    assert load_knowledge_base(spark, path).filter(F.col("source") == "user_upload").count() == 0


def _raw_kb(spark):
    rows = [("C", "s", "x", "Q?", "A", 0, 0, 0)]
    df = spark.createDataFrame(rows, "category string, source string, source_sheet string, question string, "
                                     "answer string, src_no int, sheet_no long, pos long")
    return K.process_documents(df.select("category", "source", "source_sheet", "question", "answer",
                                         F.struct("src_no", "sheet_no", "pos").alias("seq")))


def test_q11_hit_overrides_missing_keyword(spark):
    kb = spark.createDataFrame([("doc_0000", "Weather", "s", "x", "Rain tomorrow?", "Bring an umbrella.",
                                 "rain tomorrow umbrella weather")],
                               "id string, category string, source string, source_sheet string, question string, "
                               "answer string, text string")
    qs = spark.createDataFrame([(1, "rain tomorrow")], "query_id long, query string")
    got = answer_questions(qs, kb_vectors(kb)).first()
    assert got.route == "ok" and not got.blocked      # no domain keyword, but a hit: answered


def test_o2_zero_k_means_configured_default(spark):
    q = spark.createDataFrame([(1, [1, 0])], "query_id long, tf array<int>")
    d = spark.range(0, 8).select(F.col("id").alias("doc_id"), F.array(F.lit(1), F.lit(0)).alias("tf"))
    assert similarity_topk(q, d, vec="tf", integer=True, k=0).count() == 5
