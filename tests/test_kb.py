import os
import time

from pyspark.sql import functions as F

from askframe.operators import kb as K
from askframe.operators.util import sweep


def _raw(spark, rows):
    df = spark.createDataFrame(rows, "category string, source string, source_sheet string, question string, "
                                     "answer string, src_no int, sheet_no long, pos long")
    return df.select("category", "source", "source_sheet", "question", "answer",
                     F.struct("src_no", "sheet_no", "pos").alias("seq"))


def test_process_documents(spark):
    rows = [
        ("C", "s", "x", "What?", "First", 0, 0, 0),
        ("C", "s", "x", "  what? ", "Second copy (same key)", 0, 0, 1),
        ("c", "s", "x", "What?", "other category", 0, 0, 2),
        ("C", "s", "x", "Blank?", "   ", 0, 0, 3),
        ("C", "s", "x", "", "no question", 1, 0, 0),
        ("C", "s", "x", "Mail?", "write a@b.org", 1, 0, 1),
    ]
    kb = K.process_documents(_raw(spark, rows)).orderBy("ord").collect()
    assert [(r.id, r.category, r.question, r.answer) for r in kb] == [
        ("doc_0000", "C", "What?", "First"),
        ("doc_0001", "c", "What?", "other category"),
        ("doc_0002", "C", "", "no question"),
        ("doc_0003", "C", "Mail?", "write [EMAIL REDACTED]"),
    ]
    assert kb[2].text == "Product: C\nno question"


def test_dedup_independent_of_partitioning(spark):
    base = spark.range(0, 2000).select(
        (F.col("id") % 13).cast("string").alias("category"), F.lit("s").alias("source"),
        F.lit("x").alias("source_sheet"), (F.col("id") % 97).cast("string").alias("question"),
        F.col("id").cast("string").alias("answer"), F.lit(0).alias("src_no"), F.lit(0).cast("long").alias("sheet_no"),
        F.col("id").alias("pos")).select("category", "source", "source_sheet", "question", "answer",
                                          F.struct("src_no", "sheet_no", "pos").alias("seq"))
    a = {tuple(r) for r in K.process_documents(base).select("id", "answer").collect()}
    b = {tuple(r) for r in K.process_documents(base.repartition(17, "answer")).select("id", "answer").collect()}
    assert a == b
    ords = sorted(int(i[4:]) for i, _ in a)
    assert ords == list(range(len(a)))              # dense, unique, 0-based
    # first copy wins: the kept answer is the smallest pos of its key
    firsts = {(int(x) % 13, int(x) % 97): int(x) for x in sorted((ans for _, ans in a), key=int, reverse=True)}
    assert all(v < 13 * 97 for v in firsts.values())


def test_ids_past_9999_and_append(spark):
    df = spark.range(0, 10003).select(F.struct(F.lit(0).alias("a"), F.col("id").alias("pos")).alias("seq"))
    ided = K.assign_dense_ids(df, ["seq"], "ord", partitions=7)
    got = ided.select("ord", "seq.pos").collect()
    assert all(r.ord == r.pos for r in got)
    kb = spark.createDataFrame([("doc_0000",), ("doc_0001",)], "id string")
    uploads = spark.createDataFrame([("â€œhiâ€\x9d 0300-1234567", "Loans", 5), ("  ", "Cards", 1)],
                                    "text string, category string, pos long") \
        .select("text", "category", F.struct(F.lit(2).alias("src_no"), F.col("pos")).alias("seq"))
    new = K.append_uploads(kb, uploads).orderBy("ord").collect()
    assert [(r.id, r.category, r.source, r.source_sheet, r.question, r.answer, r.text) for r in new] == [
        ("doc_0002", "Cards", "user_upload", "Cards", "", "", "Product: Cards\n"),
        ("doc_0003", "Loans", "user_upload", "Loans", "", '"hi" [PHONE REDACTED]', 'Product: Loans\n"hi" [PHONE REDACTED]'),
    ]


def test_breakdowns(spark):
    kb = spark.createDataFrame([("a", "s1", "x"), ("b", "s1", "x"), ("a", "s2", "y")],
                               "category string, source string, source_sheet string")
    got = [tuple(r) for r in K.category_breakdown(kb).collect()]
    assert got == [("a", 2, False), ("b", 1, False), (None, 3, True)]
    assert sorted(tuple(r) for r in K.source_counts(kb).collect()) == [("s1", "x", 2), ("s2", "y", 1)]


def _checkpoint_mb(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(f"{at}/{n}") for at, _, names in os.walk(root) for n in names if "/rdd-" in at) / 1e6


def test_a_build_leaves_no_copies_of_its_rows_behind(spark, tmp_path):
    from askframe.jobs import build_knowledge_base
    sheets = spark.range(400).selectExpr("concat('s', id % 4) AS sheet", "CAST(id % 4 AS INT) AS sheet_no", "id AS row_no",
                                         "array(CASE WHEN id % 8 < 4 THEN concat('q', id, '?') ELSE repeat(concat('a', id), 1000) END) AS cells")
    sheets.write.parquet(str(tmp_path / "sheets"))
    sweep(spark)
    time.sleep(2)  # the cleaner's own thread
    before = _checkpoint_mb(spark)
    kb = build_knowledge_base(spark, kb_path=str(tmp_path / "kb"), sheet_rows_path=str(tmp_path / "sheets"), skip_sheets=[])
    assert kb.count() == 200 and kb.agg(F.sum(F.length("answer"))).first()[0] > 0.6e6
    for _ in range(40):  # the cleaner takes a while
        if _checkpoint_mb(spark) < before + 0.2:
            break
        time.sleep(0.25)
    assert _checkpoint_mb(spark) < before + 0.2


def test_numbered_rows_are_stored_once(spark):
    before = _checkpoint_mb(spark)
    rows = spark.range(300).selectExpr("id", "sha2(CAST(id AS STRING), 512) || repeat(CAST(id AS STRING), 2000) AS t")
    kept = K.assign_dense_ids(rows, ["id"])
    size = kept.agg(F.sum(F.length("t"))).first()[0] / 1e6
    assert size > 1.5 and _checkpoint_mb(spark) - before < 1.5 * size
    assert [r.ord for r in kept.orderBy("id").collect()] == list(range(300))
