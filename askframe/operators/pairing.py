"""Question/answer pairing over ordered sheet rows (gaps and islands).

Each question row opens a group; the rows after it, up to the next question,
are its answer.  Rows before a sheet's first question answer
``What is <product>?`` — only when some question follows.

Skew: one sheet may hold a third of all rows, so no row-level window is
partitioned by sheet.  Rows are cut into fixed-size blocks of ``row_no``; the
running question count is a window per (sheet, block) plus the block's offset,
and offsets come from a per-sheet window over block counts (one row per block).
Answers are concatenated in two levels (inside a block, then across blocks),
so no single ``collect_list`` holds more than one block of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askframe.functions.text import py_strip


def pair_questions(lines: DataFrame, sheet_cols: list[str], order_col: str = "row_no",
                   text_col: str = "text", is_q_col: str = "is_q", product_col: str = "product",
                   block_rows: int = 1 << 16) -> DataFrame:
    """``lines``: one row per kept (non-empty, non-title) sheet row.

    Returns ``sheet_cols + [pos, product, question, answer]`` where ``pos`` is
    the group number (0 = preamble) and gives the document order in the sheet.
    """
    keys = [F.col(c) for c in sheet_cols]
    rows = (lines.select(*keys, F.col(order_col).alias("_row"), F.col(text_col).alias("_text"),
                         F.col(is_q_col).cast("int").alias("_q"), F.col(product_col).alias("_product"))
                 .withColumn("_block", F.floor(F.col("_row") / F.lit(block_rows)).cast("long")))

    # One exchange by (sheet, block) carries the cleaned rows; the running count inside
    # the block and the block total are windows over it, and the block offsets are
    # derived from the same windowed rows (the shuffle is reused, rows are cleaned once).
    in_block = Window.partitionBy(*sheet_cols, "_block")
    rows = (rows.withColumn("_run", F.sum("_q").over(in_block.orderBy("_row")
                                                     .rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("_bq", F.sum("_q").over(in_block)))
    block_stats = rows.groupBy(*sheet_cols, "_block").agg(F.max("_bq").alias("_bq"))
    per_sheet = Window.partitionBy(*sheet_cols).orderBy("_block")
    block_stats = (block_stats
                   .withColumn("_off", F.coalesce(F.sum("_bq").over(
                       per_sheet.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                   .withColumn("_sheet_q", F.sum("_bq").over(Window.partitionBy(*sheet_cols)))
                   .drop("_bq"))
    grouped = (rows.join(block_stats, on=sheet_cols + ["_block"], how="inner")
                   .withColumn("_g", F.col("_off") + F.col("_run")))

    # lines before the first question of a sheet without questions are dropped before anything is gathered
    grouped = grouped.filter((F.col("_g") > 0) | (F.col("_sheet_q") >= 1))

    # level 1: inside one block
    lvl1 = (grouped.groupBy(*sheet_cols, "_g", "_block")
            .agg(F.max(F.when(F.col("_q") == 1, F.col("_text"))).alias("_question"),
                 F.first("_product").alias("_product"),
                 F.sort_array(F.collect_list(F.when(F.col("_q") == 0,
                                                    F.struct(F.col("_row"), F.col("_text"))))).alias("_parts")))
    lvl1 = (lvl1.withColumn("_n", F.size("_parts"))
                .withColumn("_chunk", F.array_join(F.transform("_parts", lambda p: p["_text"]), "\n")))
    # level 2: across the blocks of one group
    lvl2 = (lvl1.groupBy(*sheet_cols, "_g")
            .agg(F.max("_question").alias("_question"), F.first("_product").alias("_product"),
                 F.sort_array(F.collect_list(F.when(F.col("_n") > 0,
                                                    F.struct(F.col("_block"), F.col("_chunk"))))).alias("_chunks")))
    answer = py_strip(F.array_join(F.transform("_chunks", lambda c: c["_chunk"]), "\n"))
    question = F.when(F.col("_g") == 0, F.concat(F.lit("What is "), F.col("_product"), F.lit("?"))) \
                .otherwise(F.col("_question"))
    out = lvl2.select(*keys, F.col("_g").alias("pos"), F.col("_product").alias("product"),
                      question.alias("question"), answer.alias("answer"))
    return out.filter(F.col("answer") != "")
