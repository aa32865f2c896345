import json

from pyspark.sql import functions as F

from askframe.sources.faq import flatten_faq
from askframe.sources.uploads import decode_uploads, read_uploads


def test_decode_rules(spark):
    rows = [("a.txt", b"caf\xc3\xa9 \xff end"), ("b.json", b'{"b": 1, "a": "x"}'),
            ("c.json", b'["line one", {"k": 2}, 3]'), ("d.json", b"{not json"), ("e.json", b"42"),
            ("f.txt", b'{"k": 1}')]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = dict(decode_uploads(df).select("path", "text").collect())
    assert got == {"a.txt": "café � end", "b.json": '{"a":"x","b":1}', "c.json": 'line one\n{"k":2}\n3',
                   "d.json": "{not json", "e.json": "42", "f.txt": '{"k": 1}'}


def test_read_uploads_category_from_folder(spark, tmp_path):
    (tmp_path / "Loans").mkdir()
    (tmp_path / "Loans" / "a.txt").write_bytes(b"hello")
    (tmp_path / "Cards").mkdir()
    (tmp_path / "Cards" / "b.json").write_text(json.dumps(["x", "y"]))
    (tmp_path / "Cards" / "skip.csv").write_text("no")
    got = sorted((r.category, r.text) for r in read_uploads(spark, str(tmp_path)).collect())
    assert got == [("Cards", "x\ny"), ("Loans", "hello")]


def test_flatten_faq(spark, tmp_path):
    doc = {"categories": [
        {"category": "Transfers", "questions": [{"question": "â€œHow?â€\x9d", "answer": "Like this."},
                                                {"question": "Empty?", "answer": ""}]},
        {"questions": [{"question": "Q2", "answer": "A2"}]}]}
    p = tmp_path / "faq.json"
    p.write_text(json.dumps(doc), encoding="utf-8")
    from askframe.sources.faq import read_faq_json
    got = flatten_faq(read_faq_json(spark, str(p))).orderBy("seq").collect()
    assert [(r.category, r.source_sheet, r.question, r.answer, r.source) for r in got] == [
        ("Transfers", "Transfers", '"How?"', "Like this.", "faq.json"),
        ("General", "General", "Q2", "A2", "faq.json")]
    assert F is not None
