"""Sheet rows (one row per spreadsheet row, cells as strings) to raw Q/A rows.

Decoding the workbook file itself is out of scope; the input is the table
``sheet_rows(sheet string, sheet_no int, row_no long, cells array<string>)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe import rules
from askframe.functions.text import is_question, py_strip, row_to_text
from askframe.operators.pairing import pair_questions
from askframe.session import checkpoint_dir


def _drop_dots(col):
    return F.regexp_replace(py_strip(col), r"\.+\z", "")


def sheet_products(sheet_rows: DataFrame, sheet_map: DataFrame | None,
                   skip_sheets: list[str] | None = None) -> DataFrame:
    """Drop skipped sheets, attach the product name (mapped, else the stripped sheet code)."""
    skips = rules.SKIP_SHEETS if skip_sheets is None else skip_sheets
    rows = sheet_rows.filter(~F.col("sheet").isin(*skips)) if skips else sheet_rows
    if sheet_map is None:
        return rows.withColumn("product", py_strip(F.col("sheet")))
    m = sheet_map.select(F.col("sheet").alias("_map_sheet"), F.col("product").alias("_map_product"))
    # no hint: Spark broadcasts the map if its size in bytes allows, and splits a hot sheet otherwise
    joined = rows.join(m, rows["sheet"] == m["_map_sheet"], "left")
    return (joined.withColumn("product", F.coalesce(F.col("_map_product"), py_strip(F.col("sheet"))))
                  .drop("_map_sheet", "_map_product"))


def sheet_lines(sheet_rows: DataFrame, sheet_map: DataFrame | None = None,
                skip_sheets: list[str] | None = None) -> DataFrame:
    """Merged row text, with empty rows and title rows (equal to the product name) removed."""
    rows = sheet_products(sheet_rows, sheet_map, skip_sheets)
    rows = rows.withColumn("text", row_to_text(F.col("cells")))
    return (rows.filter(F.col("text") != "")
                .filter(_drop_dots(F.col("text")) != _drop_dots(F.col("product")))
                .withColumn("is_q", is_question(F.col("text"))))


def parse_sheets(sheet_rows: DataFrame, sheet_map: DataFrame | None = None,
                 skip_sheets: list[str] | None = None, source: str = "workbook.xlsx",
                 src_no: int = 0, question_flag=None) -> DataFrame:
    """Raw Q/A rows: ``category, source, source_sheet, question, answer, seq``.

    ``question_flag`` (a boolean column of ``sheet_rows``) marks extra question
    rows besides those whose text ends with ``?``.
    """
    lines = sheet_lines(sheet_rows, sheet_map, skip_sheets)
    if question_flag is not None:
        lines = lines.withColumn("is_q", F.col("is_q") | F.coalesce(question_flag, F.lit(False)))
    # Pairing reads its input twice (per-block question counts, then the rows); the
    # cleaned lines are written once to the shared checkpoint folder instead of
    # running the cleaning expressions twice.
    checkpoint_dir(lines.sparkSession)
    lines = lines.select("sheet", "sheet_no", "row_no", "text", "is_q", "product").checkpoint(eager=True)
    pairs = pair_questions(lines, ["sheet", "sheet_no"], order_col="row_no")
    return pairs.select(
        F.col("product").alias("category"), F.lit(source).alias("source"),
        F.col("sheet").alias("source_sheet"), "question", "answer",
        F.struct(F.lit(src_no).alias("src_no"), F.col("sheet_no").cast("long").alias("sheet_no"),
                 F.col("pos").cast("long").alias("pos")).alias("seq"))
