"""Empty inputs flow through every main operator without errors."""

from pyspark.sql import functions as F

from askframe.operators import kb as K
from askframe.operators.answer import answer_questions
from askframe.operators.embed import hashed_vectors
from askframe.operators.similarity import similarity_topk
from askframe.operators.vectors import kb_vectors


def test_empty_everything(spark):
    kb = spark.createDataFrame([("doc_0000", "C", "s", "x", "Q?", "A", "Product: C\nQ?\nA")],
                               "id string, category string, source string, source_sheet string, question string, "
                               "answer string, text string")
    no_q = spark.createDataFrame([], "query_id long, query string")
    assert answer_questions(no_q, kb_vectors(kb)).count() == 0
    qs = spark.createDataFrame([(1, "Q")], "query_id long, query string")
    got = answer_questions(qs, kb_vectors(kb.limit(0))).first()
    assert got.route == "off"                     # no keyword and nothing to find
    empty_docs = spark.createDataFrame([], "doc_id long, tf array<int>")
    qv = hashed_vectors(qs, "query", ["query_id"]).select("query_id", "tf")
    assert similarity_topk(qv, empty_docs, vec="tf", integer=True).count() == 0
    raw = spark.createDataFrame([("C", "s", "x", "Q?", "   ", 0, 0, 0)],
                                "category string, source string, source_sheet string, question string, answer string, "
                                "src_no int, sheet_no long, pos long") \
        .select("category", "source", "source_sheet", "question", "answer",
                F.struct("src_no", "sheet_no", "pos").alias("seq"))
    assert K.process_documents(raw).count() == 0
