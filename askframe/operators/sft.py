"""Fine-tuning rows, chat messages and the length profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe import rules
from askframe.functions.text import py_strip

# A chat template in the common "im_start" style; the real one belongs to the
# model and is a parameter.
DEFAULT_TEMPLATE = "<|im_start|>{role}\n{content}<|im_end|>\n"


def sft_rows(kb: DataFrame) -> DataFrame:
    """``(id, instruction, response)`` for every KB row with a non-blank answer."""
    q = py_strip(F.coalesce("question", F.lit("")))
    a = py_strip(F.coalesce("answer", F.lit("")))
    head = F.concat(F.lit("Product: "), F.coalesce("category", F.lit("")), F.lit("\n"))
    instr = F.when(q != "", F.concat(head, F.lit("Question: "), q)) \
             .otherwise(F.concat(head, F.lit(rules.SFT_SUMMARIZE)))
    return kb.select("id", instr.alias("instruction"), a.alias("response")).filter(F.col("response") != "")


def sft_messages(rows: DataFrame, profile: rules.Profile = rules.DEFAULT_PROFILE,
                 template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Adds ``messages`` (system, user, assistant) and ``text`` rendered with ``template``."""
    system = rules.texts(profile).system_prompt
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    pre, rest = template.split("{role}")
    mid, post = rest.split("{content}")
    render = F.transform("messages", lambda m: F.concat(F.lit(pre), m["role"], F.lit(mid), m["content"], F.lit(post)))
    return rows.withColumn("messages", msgs).withColumn("text", F.array_join(render, ""))


def length_profile(rows: DataFrame, cols: tuple[str, ...] = ("instruction", "response")) -> DataFrame:
    """``(field, n, mean, std, min, p25, p50, p75, max)`` of character lengths.

    Exact interpolating percentiles: Spark's ``percentile`` keeps one counter
    per distinct length, so its state is bounded by the number of distinct
    lengths, not by the number of rows.
    """
    aggs = []
    for c in cols:
        n = F.char_length(c)
        aggs += [F.count(n).alias(f"{c}_n"), F.round(F.avg(n), 6).alias(f"{c}_mean"),
                 F.round(F.stddev_samp(n), 6).alias(f"{c}_std"), F.min(n).cast("double").alias(f"{c}_min"),
                 F.percentile(n, [0.25, 0.5, 0.75]).alias(f"{c}_p"), F.max(n).cast("double").alias(f"{c}_max")]
    wide = rows.agg(*aggs)
    parts = [F.struct(F.lit(f"{c}_len").alias("field"), F.col(f"{c}_n").alias("n"),
                      F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
                      F.col(f"{c}_min").alias("min"), F.round(F.col(f"{c}_p")[0], 6).alias("p25"),
                      F.round(F.col(f"{c}_p")[1], 6).alias("p50"), F.round(F.col(f"{c}_p")[2], 6).alias("p75"),
                      F.col(f"{c}_max").alias("max")) for c in cols]
    return wide.select(F.inline(F.array(*parts)))
