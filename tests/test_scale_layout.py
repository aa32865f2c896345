"""What is written and listed grows with the data, not with tasks times folders."""
import os

from pyspark.sql import functions as F

from askframe.operators import similarity as S
from askframe.operators.index_upkeep import compact_index
from askframe.plans import catalog_jobs as J
from askframe.session import LISTING_KEY, few_listing_tasks
from askframe.sources.units import faq_files


def _docs(spark, where):
    v = F.array(*[((F.xxhash64(F.lit(i), "doc_id") % 7) + 7).cast("int") for i in range(6)])
    return spark.range(1200).withColumnRenamed("id", "doc_id").filter(where).select("doc_id", v.alias("tf")).repartition(6)


def _files(path):
    """Files of each cell and batch."""
    return {os.path.relpath(at, path): n for at, _, names in os.walk(path) if (n := sum(x.endswith(".parquet") for x in names))}


def test_a_cell_is_one_file_whatever_the_number_of_tasks(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(S.build_cells(_docs(spark, "doc_id % 2 = 0"), vec="tf", integer=True, cell_rows=64), path)
    S.add_to_index(spark, path, _docs(spark, "doc_id % 2 = 1"), "odd")
    assert set(_files(f"{path}/data").values()) == {1}
    assert compact_index(spark, path, cell_rows=32, small_rows=1 << 62)
    assert set(_files(f"{path}/data").values()) == {1}
    index = S.read_index(spark, path)
    assert sorted(r["_did"] for r in index.assigned.select("_did").collect()) == list(range(1200)) and index.counts.sum() == 1200


def test_a_large_cell_is_dealt_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FILE_ROWS", 50)
    path = str(tmp_path / "index")
    docs = spark.range(400).selectExpr("id AS doc_id", "array(1, 2) AS tf")
    S.write_index(S.build_cells(docs, vec="tf", integer=True, cell_rows=4096), path)
    files = _files(f"{path}/data")
    assert len(files) == 1 and 4 <= sum(files.values()) <= 8
    assert spark.read.parquet(f"{path}/data").select("_did").distinct().count() == 400


def _tables(spark, at):
    spark.createDataFrame([(n, t, "user", f"line {n}") for n in range(4) for t in range(2)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(n, "en", f"question {n}\nanswer {n}") for n in range(260)],
                          "doc_id long, lang string, text string").write.parquet(f"{at}/documents.parquet")


def test_faq_files_that_did_not_change_keep_their_fingerprint(spark, tmp_path):
    _tables(spark, tmp_path)
    base, found = str(tmp_path / "base"), []
    for text in ("CASE WHEN doc_id % 200 = 0 THEN concat('Once\n', text) ELSE text END", "text"):
        J._write_sources(spark, str(tmp_path), base, text=text)
        found.append({os.path.dirname(r.file): r.fp for r in faq_files(spark, f"{base}/faq/block=*/*.json", "x").collect()})
    old, new = found
    assert len(old) == 6 and {os.path.basename(f) for f in old if old[f] != new[f]} == {"block=00000000", "block=00000004"}


def test_files_are_listed_by_few_tasks(spark):
    before = spark.conf.get(LISTING_KEY)
    with few_listing_tasks(spark):
        assert int(spark.conf.get(LISTING_KEY)) <= 64
    assert spark.conf.get(LISTING_KEY) == before
