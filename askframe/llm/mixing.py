"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source with share p of all tokens gets the weight p^a / sum(p^a).  The
exponent a is bisected until the mixture meets a target: an entropy, or a limit
on how often a source's documents repeat.  Every weight becomes a quota of
tokens.  A source's documents are dealt into blocks by a hash of id and text,
equal rows also by a number among themselves; an epoch is a seeded permutation of its blocks; whole epochs are used as often as
the quota holds them, and the last epoch is cut where the quota ends.

A document's tokens are its words ``[^\\x20\\x09-\\x0D]+``, at least one.  Without a
budget, the budget is the least that uses every document at least once.

On Spark: sums per source and per block are pre-aggregated before their
shuffle, blocks hold a bounded number of tokens however large a source is, and
only a few sums over all sources reach the driver.

Defined cases: a null or empty text has one token; a null source is a source;
documents without an id are documents like others; repeated rows are repeated
documents; a text of any length is one document (one longer than a block is a
block of its own size); ties cannot arise, since every row has a key of its own;
an empty table gives no rows.  ``op4`` reads doc_id, text and source only; the
stage carries all other columns along in one struct, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askframe.llm import common

BLOCK_TOKENS = 1 << 20
MAX_REPEAT = 2.0
SECTIONS = 16
LANE_BITS = 10      # an epoch's blocks are summed in 2 ** LANE_BITS spans
EQUAL_ROWS = 10_000  # equal rows numbered by one task at a time


def _hash(seed: int, salt: str, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *columns)


def _source() -> Column:
    """The source as a key that is never null, and never equal for null and a text."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _same() -> Column:
    """A hash that equal rows share: of source, id and text."""
    return F.xxhash64(F.lit("row"), _source(), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))


def repeated(rows: DataFrame) -> DataFrame:
    """(__h, n) of the rows of ``rows`` that are not alone with their ``__h``."""
    return common.written(rows.groupBy("__h").agg(F.count("*").alias("n")).where("n > 1"), "mix-equal")


def keyed(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """``rows`` with a key ``__k`` of each row's own instead of ``__h``: equal rows are numbered from 1.

    ``equal`` has the rows' ``repeated``.  The numbers come in lanes of about
    ``EQUAL_ROWS`` rows, so that no task gets all rows that are equal.
    """
    key = lambda number: F.xxhash64(F.lit("key"), F.col("__h"), number)
    if equal.isEmpty():
        return rows.withColumn("__k", key(F.lit(0).cast("bigint"))).drop("__h")
    alone = rows.join(equal, "__h", "left_anti").withColumn("__k", key(F.lit(0).cast("bigint")))
    lane = F.pmod(F.col("__r"), F.ceil(F.col("n") / EQUAL_ROWS))
    many = common.written(rows.withColumn("__r", F.monotonically_increasing_id()).join(equal, "__h")
                          .withColumn("__lane", lane).drop("n"), "mix-lanes")
    before = W.partitionBy("__h").orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = (many.groupBy("__h", "__lane").agg(F.count("*").alias("n"))
             .select("__h", "__lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from")))
    number = F.row_number().over(W.partitionBy("__h", "__lane").orderBy("__r"))
    many = many.withColumn("__i", number).join(lanes, ["__h", "__lane"]).withColumn("__k", key(F.col("__from") + F.col("__i")))
    return alone.unionByName(many.select(*alone.columns)).drop("__h")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, __s, tokens, __k) of every row, as a table."""
    words = F.regexp_count("text", F.lit(common.WORD))
    rows = docs.select("doc_id", "source", _source().alias("__s"),
                       F.greatest(F.coalesce(words, F.lit(0)), F.lit(1)).cast("bigint").alias("tokens"), _same().alias("__h"))
    rows = common.written(rows, "mix-rows")
    equal = repeated(rows)
    return keyed(rows, equal) if equal.isEmpty() else common.written(keyed(rows, equal), "mix-keyed")


def solve_exponent(sources: DataFrame, *, entropy: float | None = None, max_repeat: float | None = None,
                   budget: int | None = None, rounds: int = 10) -> float:
    """The exponent in [0, 1] that meets the target, found by sections of ``SECTIONS`` per pass.

    ``entropy`` (nats): the largest exponent whose mixture reaches it.
    ``max_repeat``: the smallest exponent at which no document is used more
    often.  If no exponent meets the target, the nearer end of [0, 1] is taken.
    Each pass is one aggregate over the sources.
    """
    ends = sources.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not ends["all"]:
        return 1.0
    p = F.col("tokens") / float(ends["all"])
    low, high = 0.0, 1.0

    def enough(a: float, total: float, log_sum: float) -> bool:
        """True on the side of small exponents for entropy, of large ones for repetition."""
        if entropy is not None:
            return math.log(total) - log_sum / total >= entropy - 1e-12
        tokens = budget if budget is not None else ends["most"] * total / (ends["most"] / ends["all"]) ** a
        most = max(tokens * (t / ends["all"]) ** a / total / t for t in (ends["least"], ends["most"]))
        return most <= max_repeat * (1 + 1e-12)

    for _ in range(rounds):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        sums = sources.agg(*(F.sum(F.pow(p, F.lit(a))).alias(f"s{i}") for i, a in enumerate(grid)),
                           *(F.sum(F.pow(p, F.lit(a)) * F.log(p) * a).alias(f"e{i}") for i, a in enumerate(grid))).first()
        good = [enough(a, sums[f"s{i}"], sums[f"e{i}"]) for i, a in enumerate(grid)]
        if entropy is not None:
            k = max((i for i, g in enumerate(good) if g), default=-1)  # good ones come first
            if k in (-1, SECTIONS):
                return grid[max(k, 0)]
            low, high = grid[k], grid[k + 1]
        else:
            k = min((i for i, g in enumerate(good) if g), default=SECTIONS)  # good ones come last
            if k in (0, SECTIONS) and (k == 0 or not good[SECTIONS]):
                return grid[k]
            low, high = grid[k - 1], grid[k]
    return low if entropy is not None else high


def plan(rows: DataFrame, *, entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, budget: int | None = None,
         block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sources (share, weight, quota, blocks) and block uses (epoch, place in the mixture, cut) for ``sized`` rows."""
    totals = common.written(rows.groupBy("__s").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = solve_exponent(totals, entropy=entropy, max_repeat=None if entropy is not None else max_repeat, budget=budget)
    sums = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    every, most = float(sums["all"] or 1), float(sums["most"] or 1)
    total = totals.agg(F.sum(F.pow(F.col("tokens") / every, F.lit(a))).alias("s")).first()["s"] or 1.0
    weight = F.pow(F.col("tokens") / every, F.lit(a)) / total
    if budget is None:  # the largest source is used once, the others (most / tokens)^(1 - a) times
        quota = F.greatest("tokens", F.floor(F.col("tokens") * F.pow(most / F.col("tokens"), F.lit(1 - a)) + 0.5))
    else:
        quota = F.floor(weight * budget + 0.5)
    sources = totals.select("__s", F.col("tokens").alias("source_tokens"), (F.col("tokens") / every).alias("share"),
                            weight.alias("weight"), quota.cast("bigint").alias("quota"),
                            F.ceil(F.col("tokens") / block_tokens).cast("bigint").alias("n_blocks"))
    placed = rows.join(sources, "__s").withColumn("block", _block(seed))
    blocks = placed.groupBy("__s", "block").agg(F.sum("tokens").alias("block_tokens"))
    uses = (blocks.join(sources, "__s")
            .withColumn("epoch", F.explode(F.expr("sequence(0L, ceil(quota / source_tokens) - 1)")))
            .where(F.col("quota") > 0))
    # a permutation is the order of a hash; its running sums are taken inside spans of the hash and over the spans
    uses = common.written(uses.withColumn("__o", _hash(seed, "block", F.col("epoch"), F.col("__s"), F.col("block")))
                          .withColumn("__lane", F.shiftright("__o", 64 - LANE_BITS)), "mix-epochs")
    before = W.partitionBy("__s", "epoch").orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = (uses.groupBy("__s", "epoch", "__lane").agg(F.sum("block_tokens").alias("t"))
             .select("__s", "epoch", "__lane", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__from")))
    uses = uses.join(lanes, ["__s", "epoch", "__lane"])
    order = W.partitionBy("__s", "epoch", "__lane").orderBy("__o", "block").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("__from") + F.coalesce(F.sum("block_tokens").over(order), F.lit(0))
    left = F.col("quota") - F.col("epoch") * F.col("source_tokens") - F.col("start")
    uses = (uses.withColumn("start", start).withColumn("need", F.least(left, F.col("block_tokens"))).where("need > 0")
            .withColumn("mix_at", (F.col("epoch") * F.col("source_tokens") + F.col("start")) / F.col("quota"))
            .select("__s", "block", "epoch", "mix_at", "need", "block_tokens", "weight"))
    uses = common.written(uses, "mix-uses")
    # in a block that the quota cuts, documents come in the order of a hash; those that begin before the end are used
    cut = uses.where("need < block_tokens").select("__s", "block", "epoch", "need")
    inside = placed.join(cut, ["__s", "block"]).withColumn("__h", _hash(seed, "cut", F.col("__k")))
    through = W.partitionBy("__s", "block", "epoch").orderBy("__h")
    last = (inside.withColumn("end", F.sum("tokens").over(through)).where(F.col("end") - F.col("tokens") < F.col("need"))
            .groupBy("__s", "block", "epoch").agg(F.max("__h").alias("last")))
    uses = (uses.withColumn("cut", F.col("need") < F.col("block_tokens")).join(last, ["__s", "block", "epoch"], "left")
            .select("__s", "block", "epoch", "mix_at", "weight", "cut", "last"))
    return sources, common.written(uses, "mix-plan")


def _block(seed: int) -> Column:
    return F.pmod(_hash(seed, "deal", F.col("__k")), F.col("n_blocks"))


def apply_plan(rows: DataFrame, sources: DataFrame, uses: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (with ``__s`` and ``__k``), one for each use, with block, epoch, mix_at and weight.

    Sorted by (mix_at, source, block, in_block), any prefix of the result has about the target weights.
    """
    used = (rows.join(sources.select("__s", "n_blocks"), "__s").withColumn("block", _block(seed)).drop("n_blocks")
            .join(uses, ["__s", "block"]))
    return (used.where(~F.col("cut") | (_hash(seed, "cut", F.col("__k")) <= F.col("last"))).drop("cut", "last")
            .withColumn("in_block", _hash(seed, "order", F.col("epoch"), F.col("__k"))))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with at most ``MAX_REPEAT`` uses each: one row per use."""
    rows = sized(common.read(spark, sf_dir, "documents"))
    sources, uses = plan(rows)
    return apply_plan(rows, sources, uses).select("doc_id", "source", "tokens", "weight", "epoch", "block", "mix_at", "in_block")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents, each as often as the mixture uses it (at least once), columns as they were.

    Columns of the plan have other names than those of the documents: ``docs``
    travels as one struct.
    """
    sources, uses = plan(sized(docs))
    whole = docs.select(_source().alias("__s"), _same().alias("__h"), F.struct(*docs.columns).alias("__row"))
    whole = keyed(whole, repeated(whole.select("__h")))
    return apply_plan(whole, sources, uses).select(*(F.col("__row")[c].alias(c) for c in docs.columns))
