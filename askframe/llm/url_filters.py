"""URL filters: rules on hosts and paths found by hashed expressions.

A rule names a host and the beginning of a path.  Its key is the host with the
path up to its last slash.  Every URL is expanded into the keys that could fit
it: each suffix of its host's labels with each beginning of its path that ends
in a slash (and the empty one), no longer in labels or slashes than the longest
rule.  Keys meet rules by an equi-join on the first ``PREFIX`` hex digits of
their SHA-256; the full digest, the labels and the rest of the rule's path are
confirmed afterwards, and the longest rule wins (host and path together; then
the longer host; then block before allow).

Only distinct (host, path) pairs are expanded, so a URL that many pages share
is judged once.  The join carries no hint: Spark broadcasts the rules if they
are small by its own size limit, else both sides are shuffled by the digits.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
an empty host or a path without a slash fits only rules that say so; repeated
rows are judged each; without a rule that fits, the verdict is ``default``;
URLs of any length are judged whole; an empty table gives no rows; other
columns pass through ``judge_urls`` untouched, but must not bear the names of
its results (a ValueError).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import common

PREFIX = 8          # hex digits of the digest that keys are joined on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

ADDED = ["host", "path", "rule", "verdict"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, folder: Column) -> Column:
    # a host holds no slash, a folder starts with one or is empty: the text names both
    return F.sha2(F.concat(host, folder), 256)


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their keys: digest, its first digits, labels and slashes."""
    folder = F.regexp_extract("path", r"(?s)^(.*/)?", 0)
    return rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        F.length(F.regexp_replace("host", r"[^.]", "")).alias("dots"), F.length(F.regexp_replace("path", r"[^/]", "")).alias("slashes"),
        _digest(F.col("host"), folder).alias("rule_digest")).withColumn("digits", F.substring("rule_digest", 1, PREFIX))


def expressions(urls: DataFrame, labels: int, slashes: int) -> DataFrame:
    """(host, path, digits, digest, dots, depth): the keys that a rule fitting (host, path) can have."""
    n_dots = F.length(F.regexp_replace("host", r"[^.]", ""))
    n_slashes = F.length(F.regexp_replace("path", r"[^/]", ""))
    hosts = urls.select("host", "path", F.explode(F.sequence(F.lit(0), F.least(n_dots, F.lit(labels - 1)))).alias("dots"),
                        F.least(n_slashes, F.lit(slashes)).alias("most"))
    keys = hosts.select("host", "path", "dots", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("depth"))
    suffix = F.expr("substring_index(host, '.', -(dots + 1))")
    folder = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.expr("substring_index(path, '/', depth)"), F.lit("/")))
    return keys.select("host", "path", "dots", "depth", _digest(suffix, folder).alias("digest")) \
        .withColumn("digits", F.substring("digest", 1, PREFIX))


def winning_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) pairs that a rule fits."""
    keys = common.written(rule_keys(rules.where("host IS NOT NULL AND path IS NOT NULL")), "rule-keys")
    most = keys.agg(F.max("dots"), F.max("slashes")).first()
    labels, slashes = (most[0] if most[0] is not None else 0) + 1, most[1] or 0
    met = expressions(urls.select("host", "path").distinct(), labels, slashes).join(keys.select("digits", "rule_digest", "rule_host", "rule_path", "rule_verdict"), "digits")
    fits = ((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
            & ((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host")))))
    order = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"),
                     (F.col("rule_verdict") == "block").alias("blocks"))
    return (met.where(fits).groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("won"))
            .select("host", "path", "won.rule", "won.verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    clash = [c for c in pages.columns if c.lower() in ADDED]
    if clash:
        raise ValueError(f"columns {clash} have names of the result's columns")
    host, path = url_parts(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path)
    # a table: with both sides of the last join read from files, Spark can split a URL that many pages share
    won = common.written(winning_rules(rows, rules), "url-rules")
    return (rows.join(won, ["host", "path"], "left")
            .select(*pages.columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(common.read(spark, sf_dir, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")
