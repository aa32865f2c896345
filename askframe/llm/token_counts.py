"""Token counts: an exact histogram of encoded lengths answers every context limit.

Documents are encoded with a public byte-pair vocabulary (a file given by
path) and counted by length; suffix sums over the distinct lengths give totals,
quantiles and truncated totals for any limit without another pass over texts.

Defined cases: a null or empty text has length 0; bytes that are not UTF-8
count as U+FFFD; texts of any length are encoded whole (runs of white space
over ``LONG_RUN`` are cut out by hand, just as the pattern cuts them); repeated
rows count each time; ties cannot arise (a histogram); an empty table gives an
empty histogram; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askframe.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A run of white space longer than this would overflow the pattern engine's stack.
LONG_RUN = 1000
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")

_ENCODERS: dict[str, object] = {}


def encoder(raw: bytes):
    """The encoder of a vocabulary file's content, built once per Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _ENCODERS:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key[:12], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encoded_length(enc, text: str) -> int:
    """Tokens of a whole text.

    The pattern takes a run of white space before a word without its last
    character, which goes on as the word's beginning, and a run at the end
    whole; so a long run is one piece, and the texts around it stand alone.
    """
    n, at = 0, 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(enc.encode_ordinary(text[at:run.start()])) + len(enc._encode_single_piece(text[run.start():end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One ``length`` (bigint) for every row's whole text; the file is read on the driver and travels with the tasks."""
    with open(vocabulary, "rb") as f:
        raw = f.read()

    def run(batches):
        enc = encoder(raw)
        for batch in batches:
            n = np.fromiter((encoded_length(enc, t) for t in common.texts(batch.column(0))), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["length"])

    return docs.select("text").mapInArrow(run, "length bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs), one row per distinct length; map-side counts go through the shuffle."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, width: int = 512) -> DataFrame:
    """For each distinct length L, taken as a context limit, what documents of at least L hold.

    Sums run inside ranges of ``width`` lengths and over the ranges' totals; the one task over the totals sees a row
    per range (the longest text divided by ``width``).
    """
    spans = hist.withColumn("span", F.floor(F.col("length") / width)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    per = spans.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    per = per.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                     F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                     F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = W.partitionBy("span").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    at_least = spans.join(per, "span").select(
        "length", "n_docs", "tokens", (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_at_least"), "total_docs", "total_tokens")
    return at_least.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")) \
        .withColumn("share_at_most", 1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("total_docs"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents cut and tokens kept at any limits: one pass, one row per limit.

    The tokens of documents above a limit c count c each: the sums give
    sum(min(length, c)) from the rows below c and the count of the others.
    """
    parts = []
    for c in sorted(set(limits)):
        over = F.col("length") > c
        parts += [F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias(f"cut_{c}"),
                  F.sum(F.when(over, F.col("n_docs") * c).otherwise(F.col("tokens"))).alias(f"kept_{c}")]
    pairs = ", ".join(f"{c}L, cut_{c}, kept_{c}" for c in sorted(set(limits)))
    return sums.agg(*parts).selectExpr(f"stack({len(set(limits))}, {pairs}) AS (context_limit, docs_cut, tokens_kept)")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least a share of the documents does not exceed, for each share."""
    got = sums.agg(*(F.min(F.when(F.col("share_at_most") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)))
    pairs = ", ".join(f"{q}D, q{i}" for i, q in enumerate(shares))
    return got.selectExpr(f"stack({len(shares)}, {pairs}) AS (share, length)")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents with its suffix sums, one row per distinct length."""
    common.ready(spark)
    hist = common.written(histogram(encoded_lengths(common.read(spark, sf_dir, "documents"))), "length-histogram")
    return suffix_sums(hist)
