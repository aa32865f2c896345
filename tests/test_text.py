from pyspark.sql import functions as F

from askframe.functions import text as T
from helpers import one


def test_fix_encoding_sequences(spark):
    cases = {
        "â€œhiâ€\x9d": '"hi"',
        "itâ€™s â€˜xâ€˜": "it's 'x'",
        "a â\x80\x93 b â\x80\x94 c": "a – b — c",
        "Â·dot": "·dot",
        "crÂème": "crème",          # every Â is deleted, even a legitimate one (kept as in the rebuilt behaviour)
        "a\xa0b": "a b",
        "zero​width": "zerowidth",
        "– —": "– —",
        "a\n\n\n\nb": "a\n\nb",
        "  \t padded \n": "padded",
        "　wide ": "wide",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = dict(df.select("x", T.fix_encoding("x").alias("y")).collect())
    assert got == cases
    assert one(spark, T.fix_encoding(F.col("x")), None) == ""


def test_is_question(spark):
    df = spark.createDataFrame([("1.What is it?",), ("12. How?  ",), ("I would like to inquire...?",),
                                ("No question.",), ("?x",), ("  Why?\n",)], "x string")
    got = [r[0] for r in df.select(T.is_question("x")).collect()]
    assert got == [True, True, True, False, False, True]


def test_clean_cell_and_row(spark):
    rows = [(["=A1", "12.5", " Main ", None, "none", "Rate  ", "12", "3.", "x=1"],)]
    df = spark.createDataFrame(rows, "cells array<string>")
    assert df.select(T.row_to_text("cells")).first()[0] == "Rate  |  x=1"
    df2 = spark.createDataFrame([([None, "", "main"],)], "cells array<string>")
    assert df2.select(T.row_to_text("cells")).first()[0] == ""


def test_doc_text_and_ids(spark):
    df = spark.createDataFrame([("Cat", "Q?", "A"), ("Cat", "", "A")], "c string, q string, a string")
    got = [r[0] for r in df.select(T.doc_text("c", "q", "a")).collect()]
    assert got == ["Product: Cat\nQuestion: Q?\nAnswer: A", "Product: Cat\nA"]
    nums = spark.createDataFrame([(0,), (7,), (9999,), (10000,), (123456,)], "n long")
    assert [r[0] for r in nums.select(T.doc_id("n")).collect()] == \
        ["doc_0000", "doc_0007", "doc_9999", "doc_10000", "doc_123456"]


def test_first_line_split(spark):
    df = spark.createDataFrame([("é1\nrest\nmore",), ("single",)], "x string")
    got = df.select(T.first_line("x"), T.after_first_line("x")).collect()
    assert [tuple(r) for r in got] == [("é1", "rest\nmore"), ("single", "")]
