"""Incremental builds: source units (a sheet, an FAQ file) are processed again only when their content changed.

Every unit has a fingerprint: of a sheet the number of its rows with two
order-free sums of row hashes, its product name and the build's settings, of a
file the SHA-256 of its bytes.  A store keeps each processed unit's rows
(parsed, cleaned, redacted) under its fingerprint; a build processes the
fingerprints that the store lacks and folds the rows of all present units:
keep-first, number, write.  So a build equals a full one, and parsing, cleaning
and redaction cost what changed.  Order is not part of what is stored: where a
file stands among the files is looked up when folding.

A run's rows count once its list of finished units is written, so a run that
died leaves nothing behind that is read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe import rules
from askframe.operators import kb as K
from askframe.operators.util import materialize
from askframe.session import few_listing_tasks
from askframe.sources.faq import FAQ_SCHEMA, flatten_faq
from askframe.sources.kb_store import path_exists
from askframe.sources.sheets import parse_sheets, sheet_products

STORED = "fp string, category string, source string, source_sheet string, question string, answer string, src_no int, sheet_no long, pos long"
SHEETS, FAQ = 0, 1


def _settings(*parts) -> str:
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def sheet_units(rows: DataFrame, sheet_map: DataFrame | None, skip_sheets: list[str] | None, settings: str) -> DataFrame:
    """(sheet, sheet_no, fp) of every sheet that is not skipped."""
    row = F.struct("row_no", "cells")
    sums = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")).cast("string") for salt in (11, 47)]
    told = (sheet_products(rows, sheet_map, skip_sheets).groupBy("sheet", "sheet_no")
            .agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums, F.max("product"), F.min("product")).alias("told")))
    return told.select("sheet", "sheet_no", F.sha2(F.concat_ws("|", F.lit("sheet"), F.lit(settings), F.col("sheet"),
                                                              F.col("sheet_no").cast("string"), "told"), 256).alias("fp"))


def faq_files(spark: SparkSession, path: str, settings: str) -> DataFrame:
    """(file, content, fp) of every FAQ file; equal files at different paths are units of their own."""
    with few_listing_tasks(spark):
        files = spark.read.text(path, wholetext=True)
    files = files.select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return files.withColumn("fp", F.sha2(F.concat_ws("|", F.lit("faq"), F.lit(settings), "file", F.sha2("content", 256)), 256))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and fingerprints of the units that finished runs have processed; a unit that two runs did counts once."""
    if not path_exists(spark, f"{path}/done"):
        return spark.createDataFrame([], f"run string, {STORED}"), spark.createDataFrame([], "fp string, run string")
    done = (spark.read.schema("fp string, run string").parquet(f"{path}/done")
            .groupBy("fp").agg(F.min("run").alias("run")))
    return spark.read.schema(f"{STORED}, run string").parquet(f"{path}/rows"), done


def _parsed_faq(files: DataFrame, src_no: int) -> DataFrame:
    one = F.explode(F.from_json("content", T.ArrayType(FAQ_SCHEMA))).alias("doc")
    docs = (files.select("file", "fp", one).filter(F.col("doc").isNotNull())
            .select("fp", F.col("doc.categories").alias("categories"), F.element_at(F.split("file", "/"), -1).alias("source"))
            .withColumn("_none", F.lit(0)))
    # the fingerprint rides along as the source, since flattening keeps that
    flat = flatten_faq(docs.withColumn("_tag", F.to_json(F.struct("fp", "source"))), "_none", "_tag", src_no)
    tag = F.from_json("source", "fp string, source string")
    return flat.withColumn("fp", tag["fp"]).withColumn("source", tag["source"])


def process_changes(spark: SparkSession, units_path: str, sheet_rows: DataFrame | None, sheet_map: DataFrame | None,
                    faq_path: str | None, workbook_name: str, skip_sheets: list[str] | None,
                    profile: rules.Profile) -> tuple[DataFrame, int]:
    """(raw rows of all present units, redacted; number of units processed now)."""
    settings = _settings("1", workbook_name, sorted(skip_sheets) if skip_sheets is not None else None, profile)
    _, done = _stored(spark, units_path)
    present, fresh, n = [], [], 0
    if sheet_rows is not None:
        units = materialize(sheet_units(sheet_rows, sheet_map, skip_sheets, settings))
        todo = materialize(units.join(done, "fp", "left_anti"))
        present.append(units.select("fp", F.lit(None).cast("long").alias("file_no")))
        if count := todo.count():
            n += count
            same = lambda a, b: (a["sheet"].eqNullSafe(b["sheet"])) & (a["sheet_no"].eqNullSafe(b["sheet_no"]))
            changed = sheet_rows.join(todo, same(sheet_rows, todo), "left_semi")
            raw = parse_sheets(changed, sheet_map, skip_sheets, source=workbook_name, src_no=SHEETS)
            key = todo.select(F.col("sheet").alias("source_sheet"), F.col("sheet_no").cast("long").alias("_no"), "fp")
            fresh.append(raw.join(key, raw["source_sheet"].eqNullSafe(key["source_sheet"]) & raw["seq.sheet_no"].eqNullSafe(key["_no"]))
                         .drop(key["source_sheet"]).drop("_no"))
    if faq_path is not None:
        files = faq_files(spark, faq_path, settings)
        units = materialize(files.select("file", "fp"))
        todo = materialize(units.join(done, "fp", "left_anti"))
        present.append(K.assign_dense_ids(units, ["file"], "file_no").select("fp", "file_no"))
        if count := todo.count():
            n += count
            fresh.append(_parsed_faq(files.join(todo.select("fp"), "fp", "left_semi"), FAQ))
    if n:
        raw = fresh[0]
        for f in fresh[1:]:
            raw = raw.unionByName(f)
        run = uuid.uuid4().hex
        kept = K.redact_and_filter(raw, profile).select(
            "fp", "category", "source", "source_sheet", "question", "answer", F.col("seq.src_no").cast("int").alias("src_no"),
            F.col("seq.sheet_no").alias("sheet_no"), F.col("seq.pos").alias("pos"))
        kept.write.parquet(f"{units_path}/rows/run={run}")
    now = present[0]
    for p in present[1:]:
        now = now.unionByName(p)
    now = materialize(now)
    if n:
        now.select("fp").join(done, "fp", "left_anti").write.parquet(f"{units_path}/done/run={run}")
    rows, done = _stored(spark, units_path)
    rows = rows.join(done.join(now, "fp"), ["fp", "run"])
    seq = F.struct("src_no", F.coalesce("file_no", "sheet_no").alias("sheet_no"), "pos")
    return rows.select("category", "source", "source_sheet", "question", "answer", seq.alias("seq")), n

