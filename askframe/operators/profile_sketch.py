"""Length profiles that merge: a summary per batch, the profile of all batches from the summaries alone.

A batch's summary of a field is its count, sum, sum of squares, least and
largest length, and ``points`` lengths in the middle of ``points`` equal shares
of its rows.  A point stands for its share, so a length's rank in a batch of n
rows is known to ``n / (2 * points) + 1``; ranks add up over batches, so a merged
quantile's rank is off by at most ``1 / (2 * points) + batches / n`` of all rows
(``rank_error``), however many batches there are.  Count, mean, deviation,
minimum and maximum stay exact.

A summary depends on its batch's rows only, not on how they are partitioned:
merging stored summaries and rebuilding them give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 200


def shares(points: int = POINTS) -> list[float]:
    return [(2 * i + 1) / (2 * points) for i in range(points)]


def length_summary(rows: DataFrame, cols: tuple[str, ...] = ("instruction", "response"), by: str | None = None,
                   points: int = POINTS) -> DataFrame:
    """``(field, n, total, squares, least, largest, points)`` per field, and per value of ``by`` where it is given.

    One aggregate; ``percentile`` keeps a counter per distinct length.
    """
    aggs = []
    for c in cols:
        n = F.char_length(c).cast("long")
        at = F.transform(F.percentile(n, shares(points)), lambda x: F.round(x, 6))
        aggs.append(F.struct(F.lit(f"{c}_len").alias("field"), F.count(n).alias("n"), F.sum(n).alias("total"),
                             F.sum(n * n).alias("squares"), F.min(n).alias("least"), F.max(n).alias("largest"),
                             at.alias("points")).alias(c))
    wide = rows.groupBy(*([by] if by else [])).agg(*aggs)
    return wide.select(*([by] if by else []), F.inline(F.array(*cols))).filter(F.col("n") > 0)


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """``(field, n, mean, std, min, p25, p50, p75, max, rank_error)`` of all batches; reads only their summaries."""
    n = F.col("n")
    mean = F.col("total") / n
    spread = F.greatest(F.lit(0.0), F.col("squares") - F.col("total").cast("double") * F.col("total") / n) / F.when(n > 1, n - 1)
    whole = (summaries.groupBy("field").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"),
        F.max("largest").alias("largest"), F.count(F.lit(1)).alias("batches"), F.min(F.size("points")).alias("m"),
        F.sum(n * F.size("points")).alias("weight")))
    # a point weighs its batch's rows; all weights of a field add up to rows x points
    at = (summaries.select("field", n, F.explode("points").alias("v")).groupBy("field", "v").agg(F.sum("n").alias("w"))
          .withColumn("upto", F.sum("w").over(Window.partitionBy("field").orderBy("v"))))
    joined = at.join(whole.select("field", "weight"), "field")
    quantiles = joined.groupBy("field").agg(*[F.min(F.when(4 * F.col("upto") >= q * F.col("weight"), F.col("v"))).alias(f"p{25 * q}")
                                              for q in (1, 2, 3)])
    return whole.join(quantiles, "field").select(
        "field", "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(spread), 6).alias("std"), F.col("least").cast("double").alias("min"),
        "p25", "p50", "p75", F.col("largest").cast("double").alias("max"),
        F.round(1 / (2 * F.col("m")) + F.col("batches") / n, 6).alias("rank_error"))
