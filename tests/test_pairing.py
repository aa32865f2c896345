from pyspark.sql import functions as F

from askframe.operators.pairing import pair_questions
from askframe.sources.sheets import parse_sheets

ROWS = [
    # sheet, sheet_no, row_no, cells
    ("LCA", 0, 0, ["Little Champs Account."]),          # title row (trailing dot) -> skipped
    ("LCA", 0, 1, ["A savings account for kids."]),     # preamble
    ("LCA", 0, 2, ["=A1", "12.5"]),                     # empty after cleaning
    ("LCA", 0, 3, ["1.What is the minimum balance?"]),
    ("LCA", 0, 4, ["Rs. 100", None, "Main"]),
    ("LCA", 0, 5, ["Who can open it?"]),                # question with no answer -> dropped
    ("LCA", 0, 6, ["Is there a fee?"]),
    ("LCA", 0, 7, ["No fee."]),
    ("LCA", 0, 8, ["Ever."]),
    ("NOQ", 1, 0, ["Only text here."]),                 # sheet without questions -> nothing
    ("Main", 2, 0, ["Skipped?"]),                       # skipped sheet
    (" ODD ", 3, 0, ["Intro"]),
    (" ODD ", 3, 1, ["Why?"]),
    (" ODD ", 3, 2, ["Because."]),
]
MAP = [("LCA", "Little Champs Account")]


def _rows(spark):
    return spark.createDataFrame(ROWS, "sheet string, sheet_no int, row_no long, cells array<string>")


def test_parse_sheets(spark):
    sheet_map = spark.createDataFrame(MAP, "sheet string, product string")
    got = parse_sheets(_rows(spark), sheet_map).orderBy("seq").collect()
    assert [(r.category, r.source_sheet, r.question, r.answer, r.seq.pos) for r in got] == [
        ("Little Champs Account", "LCA", "What is Little Champs Account?", "A savings account for kids.", 0),
        ("Little Champs Account", "LCA", "1.What is the minimum balance?", "Rs. 100", 1),
        ("Little Champs Account", "LCA", "Is there a fee?", "No fee.\nEver.", 3),
        ("ODD", " ODD ", "What is ODD?", "Intro", 0),
        ("ODD", " ODD ", "Why?", "Because.", 1),
    ]


def test_blocks_do_not_change_result(spark):
    rows = spark.range(0, 300).select(
        F.lit("S").alias("sheet"), F.lit(0).alias("sheet_no"), F.col("id").alias("row_no"),
        F.when(F.col("id") % 7 == 3, F.concat(F.lit("q"), F.col("id").cast("string"), F.lit("?")))
         .otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))).alias("text"),
        F.lit("P").alias("product")).withColumn("is_q", F.col("text").endswith("?"))
    big = pair_questions(rows, ["sheet"], block_rows=1 << 20).orderBy("pos").collect()
    small = pair_questions(rows, ["sheet"], block_rows=4).orderBy("pos").collect()
    assert [tuple(r) for r in big] == [tuple(r) for r in small]
    assert big[0].question == "What is P?" and big[0].answer == "line 0\nline 1\nline 2"
    assert len(big) == 1 + 300 // 7 + (1 if 300 % 7 > 3 else 0)
