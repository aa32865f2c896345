import os

from askframe.jobs import build_knowledge_base
from askframe.operators.vectors import kb_vectors, load_vector_index, load_vectors
from askframe.sources import kb_store
from askframe.streaming.intake import start_question_answering, start_upload_intake


def _file(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_upload_intake_continues(spark, tmp_path):
    src = tmp_path / "in"
    (src / "Loans").mkdir(parents=True)
    (src / "Loans" / "a.txt").write_bytes(b"Rates \xff are 0300-1234567")
    _file(src / "Cards", "b.json", '{"fee": 0}')
    kb, vec, ck = str(tmp_path / "kb"), str(tmp_path / "vec"), str(tmp_path / "ck")
    start_upload_intake(spark, str(src), kb, vec, ck).awaitTermination()
    rows = sorted((r.id, r.category, r.answer) for r in spark.read.parquet(kb).collect())
    assert rows == [("doc_0000", "Cards", '{"fee":0}'), ("doc_0001", "Loans", "Rates � are [PHONE REDACTED]")]
    assert spark.read.parquet(vec).count() == 2
    # new file, same checkpoint: only the new file is added, ids continue
    _file(src / "Loans", "c.txt", "More text")
    start_upload_intake(spark, str(src), kb, vec, ck).awaitTermination()
    rows = sorted((r.id, r.answer) for r in spark.read.parquet(kb).collect())
    assert [r[0] for r in rows] == ["doc_0000", "doc_0001", "doc_0002"] and rows[2][1] == "More text"


def test_intake_adds_to_a_built_kb_and_two_streams_add_side_by_side(spark, tmp_path):
    rows = [("LCA", 0, 0, ["How to open?"]), ("LCA", 0, 1, ["Visit a branch."])]
    spark.createDataFrame(rows, "sheet string, sheet_no int, row_no long, cells array<string>").write.parquet(str(tmp_path / "rows"))
    kb, vec, ix = (str(tmp_path / x) for x in ("kb", "vec", "ix"))
    build_knowledge_base(spark, kb_path=kb, vectors_path=vec, index_path=ix, sheet_rows_path=str(tmp_path / "rows"))
    for n in (1, 2):
        _file(tmp_path / f"in{n}" / "Cards", "a.txt", f"card text {n}")
        start_upload_intake(spark, str(tmp_path / f"in{n}"), kb, vec, str(tmp_path / f"ck{n}"), index_path=ix).awaitTermination()
    got = kb_store.load_knowledge_base(spark, kb).orderBy("ord").collect()
    assert [(r.id, r.answer) for r in got] == [("doc_0000", "Visit a branch."), ("doc_0001", "card text 1"), ("doc_0002", "card text 2")]
    assert {r.doc_id for r in load_vectors(spark, vec).collect()} == {r.id for r in got}
    index = load_vector_index(spark, ix)
    assert {r["_did"] for r in index.assigned.collect()} == {r.id for r in got} and index.counts.sum() == 3


def test_replay_completes_a_batch_once(spark, tmp_path):
    """The batch's KB rows were committed, its vectors were not, and the progress log lacks the batch."""
    _file(tmp_path / "in" / "Loans", "a.txt", "Loan text")
    kb, ck = str(tmp_path / "kb"), tmp_path / "ck"
    start_upload_intake(spark, str(tmp_path / "in"), kb, str(tmp_path / "vec1"), str(ck)).awaitTermination()
    for name in os.listdir(ck / "commits"):
        os.remove(ck / "commits" / name)
    start_upload_intake(spark, str(tmp_path / "in"), kb, str(tmp_path / "vec2"), str(ck)).awaitTermination()
    assert spark.read.parquet(kb).count() == 1
    assert spark.read.parquet(str(tmp_path / "vec2")).count() == 1


def test_small_batches_give_the_same_kb(spark, tmp_path):
    for n in range(5):
        _file(tmp_path / "in" / "Cards", f"{n}.txt", f"text {n}")
    kb, vec = str(tmp_path / "kb"), str(tmp_path / "vec")
    start_upload_intake(spark, str(tmp_path / "in"), kb, vec, str(tmp_path / "ck"), max_files_per_trigger=2).awaitTermination()
    got = spark.read.parquet(kb)
    assert got.select("batch").distinct().count() == 3
    assert sorted(r.id for r in got.collect()) == [f"doc_{n:04d}" for n in range(5)]
    assert sorted(r.answer for r in got.collect()) == [f"text {n}" for n in range(5)]


def test_question_stream(spark, tmp_path):
    kbdf = spark.createDataFrame([("doc_0000", "Cards", "s", "x", "Block card?", "Call us.",
                                   "Product: Cards\nQuestion: Block card?\nAnswer: Call us.")],
                                 "id string, category string, source string, source_sheet string, question string, "
                                 "answer string, text string")
    qs = spark.createDataFrame([(1, "block card"), (2, "   ")], "query_id long, query string")
    qs.write.parquet(str(tmp_path / "q"))
    start_question_answering(spark, str(tmp_path / "q"), "query_id long, query string", kb_vectors(kbdf),
                             str(tmp_path / "out"), str(tmp_path / "ck"), max_files_per_trigger=1).awaitTermination()
    got = {r.query_id: (r.route, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("ok", "Call us.") and got[2][0] == "blocked"
