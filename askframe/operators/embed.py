"""Text to vectors.

Two forms share one output contract (``embedding array<float>``, unit length):

* built-in hashed term counts: tokens are the runs of letters and digits of any
  script (``[\\p{L}\\p{N}]+``) in the lower-cased text, each token goes to bucket ``int(md5(token)[:8], 16) % dim``;
  the integer count vector ``tf`` and its squared norm ``sq`` are kept too, so
  similarities can be computed exactly.  Hashing runs map-side in Arrow
  batches (numpy ``bincount``), so it needs no shuffle however large the text.
* a user-supplied embedder: any ``Column -> Column`` returning ``array<float>``
  (for a real model, an iterator ``pandas_udf`` that loads it once per worker).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe import rules
from askframe.session import ship_package, small_batches

_TOKEN = re.compile(r"[^\W_]+")  # in Python: letters and digits of every script, [\p{L}\p{N}]+ elsewhere
_SPLIT = r"[^\p{L}\p{N}]+"
ROWS = 256  # rows whose counts and texts are held at once on the way out
_CACHE_MAX, _CACHE_CHARS = 1 << 18, 64  # tokens a worker keeps, and the longest of them: long ones are mostly met once


def token_bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


class _Buckets(dict):
    """Bucket of each token met by a worker; md5 runs once per distinct token, up to a bound on what is kept, in tokens and in bytes."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        bucket = token_bucket(token, self.dim)
        if len(token) <= _CACHE_CHARS:
            if len(self) >= _CACHE_MAX:
                self.clear()
            self[token] = bucket
        return bucket


def _counts_for(texts, dim: int, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts for a batch of texts: ``(n x dim int32 counts, n int64 squared norms)``.

    Only one text's tokens are held at a time.
    """
    counts = np.zeros((len(texts), dim), dtype=np.int64)
    for i, t in enumerate(texts):
        tokens = _TOKEN.findall(t.lower()) if t is not None else []
        if tokens:
            found = np.fromiter(map(buckets.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            counts[i] = np.bincount(found, minlength=dim)
    return counts.astype(np.int32), (counts * counts).sum(axis=1)


def hashed_vectors(df: DataFrame, text_col: str, keep_cols: list[str],
                   dim: int = rules.VECTOR_SIZE, engine: str = "arrow",
                   outputs: tuple[str, ...] = ("tf", "sq", "embedding")) -> DataFrame:
    """``keep_cols`` and those of ``tf array<int>, sq long, embedding array<float>`` that ``outputs`` asks for.

    ``engine="arrow"`` (default) counts map-side in Arrow batches: no shuffle.
    ``engine="sql"`` uses built-in functions only (explode, then an aggregate per
    (row, bucket) and per row): JVM-only, at the price of shuffling one row per
    distinct bucket of every text; its first ``keep_cols`` column must identify
    the row.  Both give the same vectors.
    """
    if engine == "sql":
        return _hashed_vectors_sql(df, text_col, keep_cols, dim).select(*keep_cols, *outputs)
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    kinds = {"tf": T.ArrayType(T.IntegerType(), False), "sq": T.LongType(),
             "embedding": T.ArrayType(T.FloatType(), False)}
    schema = T.StructType([df.schema[c] for c in keep_cols] + [T.StructField(c, kinds[c]) for c in outputs])

    def run(batches):
        buckets = _Buckets(dim)
        for pdf in (pdf.iloc[at:at + ROWS] for pdf in batches for at in range(0, len(pdf), ROWS)):
            counts, sqs = _counts_for(pdf[text_col].tolist(), dim, buckets)
            out = pdf[keep_cols].copy()
            if "tf" in outputs:
                out["tf"] = list(counts)
            if "sq" in outputs:
                out["sq"] = sqs
            if "embedding" in outputs:
                norms = np.sqrt(sqs.astype(np.float64))
                safe = np.where(norms > 0, norms, 1.0)
                out["embedding"] = list((counts / safe[:, None]).astype(np.float32))
            yield out[list(keep_cols) + list(outputs)]

    cols = list(keep_cols) + ([text_col] if text_col not in keep_cols else [])
    return df.select(*cols).mapInPandas(run, schema)


def _hashed_vectors_sql(df: DataFrame, text_col: str, keep_cols: list[str], dim: int) -> DataFrame:
    # the first kept column identifies a row (a deterministic key, unlike a generated row id,
    # so recomputing a lost partition joins the same rows again)
    rid = keep_cols[0]
    cols = list(keep_cols) + ([text_col] if text_col not in keep_cols else [])
    base = df.select(*cols)
    toks = base.select(rid, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), _SPLIT))
                       .alias("tok")).filter(F.col("tok") != "")
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("tok")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    counts = toks.groupBy(rid, bucket.alias("b")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    per_row = counts.groupBy(rid).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    tf = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)))
    out = (base.join(per_row, rid, "left").withColumn("tf", tf)
               .withColumn("sq", F.aggregate("tf", F.lit(0).cast("long"), lambda acc, x: acc + x * x)))
    norm = F.sqrt(F.col("sq").cast("double"))
    emb = F.when(norm > 0, F.transform("tf", lambda x: (x / norm).cast("float"))) \
           .otherwise(F.transform("tf", lambda x: x.cast("float")))
    return out.select(*keep_cols, "tf", "sq", emb.alias("embedding"))


def hashed_long_form(vectors: DataFrame, id_col: str) -> DataFrame:
    """``(id, dim, cnt, weight)`` for non-zero buckets; ``weight = round(cnt / sqrt(sq), 6)``."""
    exploded = vectors.select(id_col, "sq", F.posexplode("tf").alias("dim", "cnt")).filter(F.col("cnt") > 0)
    return exploded.select(id_col, F.col("dim").cast("int").alias("dim"), F.col("cnt").cast("long").alias("cnt"),
                           F.round(F.col("cnt") / F.sqrt(F.col("sq").cast("double")), 6).alias("weight"))


def normalized(col) -> Column:
    """Unit-length copy of an ``array<float>`` column (zero vectors stay zero)."""
    c = F.col(col) if isinstance(col, str) else col
    sq = F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n = F.sqrt(sq)
    return F.when(n > 0, F.transform(c, lambda x: (x.cast("double") / n).cast("float"))).otherwise(c)


def embed_with(df: DataFrame, text_col: str, embedder: Callable[[Column], Column] | None,
               keep_cols: list[str], dim: int = rules.VECTOR_SIZE) -> DataFrame:
    """Vectors from a user embedder (normalised), or the hashed form when none is given."""
    if embedder is None:
        return hashed_vectors(df, text_col, keep_cols, dim)
    return embed_column(df, text_col, embedder, keep_cols)


def embed_column(df: DataFrame, text_col: str, embedder: Callable[[Column], Column],
                 keep_cols: list[str], out: str = "embedding") -> DataFrame:
    """Apply a user embedder, then L2-normalise in a separate projection.

    A Python UDF may not feed a higher-order function in the same projection,
    so the raw vector is selected first.
    """
    raw = df.select(*keep_cols, embedder(F.col(text_col)).alias("_raw_embedding"))
    return raw.select(*keep_cols, normalized("_raw_embedding").alias(out))

