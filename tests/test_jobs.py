import json

import pytest

from askframe.jobs import answer_job, build_knowledge_base, evaluate_job
from askframe.sources.kb_store import append_uploads_to, load_knowledge_base


def test_build_answer_evaluate(spark, tmp_path):
    rows = [("LCA", 0, 0, ["Intro text."]), ("LCA", 0, 1, ["How to open?"]), ("LCA", 0, 2, ["Visit a branch."]),
            ("Main", 1, 0, ["Ignored?"])]
    spark.createDataFrame(rows, "sheet string, sheet_no int, row_no long, cells array<string>") \
        .write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([("LCA", "Little Champs")], "sheet string, product string").write.parquet(str(tmp_path / "map"))
    faq = {"categories": [{"category": "Transfers", "questions": [
        {"question": "How to transfer?", "answer": "Use the app, 0300-1234567."},
        {"question": "How to open?", "answer": "dup in other category"}]}]}
    (tmp_path / "faq.json").write_text(json.dumps(faq))
    kb_path, vec_path = str(tmp_path / "kb"), str(tmp_path / "vec")
    ix_path = str(tmp_path / "ix")
    kb = build_knowledge_base(spark, kb_path=kb_path, vectors_path=vec_path, index_path=ix_path,
                              sheet_rows_path=str(tmp_path / "rows"),
                              sheet_map_path=str(tmp_path / "map"), faq_path=str(tmp_path / "faq.json"))
    got = [(r.id, r.category, r.question, r.answer) for r in kb.orderBy("ord").collect()]
    assert got == [("doc_0000", "Little Champs", "What is Little Champs?", "Intro text."),
                   ("doc_0001", "Little Champs", "How to open?", "Visit a branch."),
                   ("doc_0002", "Transfers", "How to transfer?", "Use the app, [PHONE REDACTED]."),
                   ("doc_0003", "Transfers", "How to open?", "dup in other category")]
    # built already: kept without rebuild, even with a missing source listed
    again = build_knowledge_base(spark, kb_path=kb_path, vectors_path=vec_path, faq_path=str(tmp_path / "none.json"))
    assert again.count() == 4
    qs = spark.createDataFrame([(1, "transfer with the app"), (2, "")], "query_id long, query string")
    ans = {r.query_id: r for r in answer_job(spark, qs, vec_path).collect()}
    assert ans[1].route == "ok" and ans[1].answer == "Use the app, [PHONE REDACTED]." and ans[2].route == "blocked"
    via_index = {r.query_id: (r.route, r.answer) for r in answer_job(spark, qs, index_path=ix_path).collect()}
    assert via_index == {q: (r.route, r.answer) for q, r in ans.items()}
    ev = evaluate_job(spark, kb_path, vec_path).orderBy("top_k").collect()
    assert [r.top_k for r in ev] == [1, 3, 5] and ev[-1].n == 4
    up = spark.createDataFrame([("New text", "Cards", 0)], "text string, category string, pos long") \
        .selectExpr("text", "category", "named_struct('src_no', 2, 'pos', pos) AS seq")
    new = append_uploads_to(spark, kb_path, up, vectors_path=vec_path, index_path=ix_path).collect()
    assert new[0].id == "doc_0004" and load_knowledge_base(spark, kb_path).count() == 5
    assert spark.read.parquet(vec_path).filter("doc_id = 'doc_0004'").count() == 1
    # what was appended is found through the stored index too
    qs = spark.createDataFrame([(3, "new text about cards")], "query_id long, query string")
    for kw in ({"vectors_path": vec_path}, {"index_path": ix_path}):
        assert [s.doc_id for s in answer_job(spark, qs, **kw).first().sources][0] == "doc_0004"
    assert [r.n for r in evaluate_job(spark, kb_path, index_path=ix_path).collect()] == [4, 4, 4]
    # a second call without rebuild keeps the upload, and builds what is missing
    more = build_knowledge_base(spark, kb_path=kb_path, vectors_path=str(tmp_path / "vec2"), faq_path=str(tmp_path / "faq.json"))
    assert more.count() == 5 and spark.read.parquet(str(tmp_path / "vec2")).count() == 5
    assert build_knowledge_base(spark, kb_path=kb_path, faq_path=str(tmp_path / "faq.json")).count() == 5


def test_the_same_batch_key_replaces_its_rows(spark, tmp_path):
    up = spark.createDataFrame([("one", "Cards", 0), ("two", "Cards", 1)], "text string, category string, pos long") \
        .selectExpr("text", "category", "named_struct('src_no', 2, 'pos', pos) AS seq")
    for _ in range(2):
        append_uploads_to(spark, str(tmp_path / "kb"), up, key="append-a")
    assert sorted(r.id for r in load_knowledge_base(spark, str(tmp_path / "kb")).collect()) == ["doc_0000", "doc_0001"]


def test_read_errors_are_not_taken_for_absence(spark, tmp_path):
    import pyspark.errors
    from askframe.sources import kb_store
    (tmp_path / "kb").mkdir()
    assert not kb_store.has_rows(spark, str(tmp_path / "kb")) and not kb_store.has_rows(spark, str(tmp_path / "none"))
    (tmp_path / "kb" / "part.parquet").write_bytes(b"this is no parquet file at all")
    with pytest.raises(Exception) as e:
        kb_store.has_rows(spark, str(tmp_path / "kb"))
    assert not isinstance(e.value, AssertionError) and pyspark.errors is not None


def test_globs_and_several_faq_files(spark, tmp_path):
    for n in (1, 2):
        faq = {"categories": [{"category": "C", "questions": [{"question": "Same?", "answer": f"answer {n}"},
                                                              {"question": f"Only {n}?", "answer": "x"}]}]}
        (tmp_path / f"f{n}.json").write_text(json.dumps(faq))
    kb = build_knowledge_base(spark, kb_path=str(tmp_path / "kb"), faq_path=str(tmp_path / "*.json"))
    rows = [(r.id, r.question, r.answer, r.source) for r in kb.orderBy("ord").collect()]
    assert rows == [("doc_0000", "Same?", "answer 1", "f1.json"), ("doc_0001", "Only 1?", "x", "f1.json"),
                    ("doc_0002", "Only 2?", "x", "f2.json")]


def test_evaluation_with_a_model_embedder(spark, tmp_path):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("array<float>")
    def letters(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"])

    faq = {"categories": [{"category": "C", "questions": [{"question": q, "answer": q * 2} for q in ("fox dog", "jazz quiz", "mmm nnn")]}]}
    (tmp_path / "f.json").write_text(json.dumps(faq))
    paths = dict(kb_path=str(tmp_path / "kb"), vectors_path=str(tmp_path / "v"), index_path=str(tmp_path / "i"))
    build_knowledge_base(spark, faq_path=str(tmp_path / "f.json"), embedder=letters, **paths)
    a = evaluate_job(spark, paths["kb_path"], paths["vectors_path"], embedder=letters).collect()
    b = evaluate_job(spark, paths["kb_path"], index_path=paths["index_path"], embedder=letters).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and all(r.topk_match > 0.6 for r in a)


def test_missing_kb_is_explained(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Build it first"):
        load_knowledge_base(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        build_knowledge_base(spark, kb_path=str(tmp_path / "kb"), faq_path=str(tmp_path / "none.json"))


def test_index_stats_or_error(spark, tmp_path):
    from askframe.operators.vectors import index_stats_at
    bad = index_stats_at(spark, str(tmp_path / "missing")).first()
    assert bad.vectors_count is None and bad.error
    spark.createDataFrame([("d1", [1.0, 0.0])], "doc_id string, embedding array<float>").write.parquet(str(tmp_path / "v"))
    ok = index_stats_at(spark, str(tmp_path / "v")).first()
    assert (ok.vectors_count, ok.vector_size, ok.error) == (1, 2, None)


def test_index_exists_probe(spark, tmp_path):
    from askframe.operators.vectors import index_exists
    assert not index_exists(spark, str(tmp_path / "none"))
    spark.createDataFrame([], "doc_id string, embedding array<float>").write.parquet(str(tmp_path / "empty"))
    assert not index_exists(spark, str(tmp_path / "empty"))           # exists but holds no vectors
    spark.createDataFrame([("d", [1.0])], "doc_id string, embedding array<float>").write.parquet(str(tmp_path / "one"))
    assert index_exists(spark, str(tmp_path / "one"))
