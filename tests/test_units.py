"""Incremental builds equal full ones and process only what changed."""

import json

import pytest

from askframe import rules
from askframe.jobs import build_knowledge_base
from askframe.sources import units as U
from askframe.sources.kb_store import load_knowledge_base

SCHEMA = "sheet string, sheet_no int, row_no long, cells array<string>"


def _sheets(spark, path, sheets):
    rows = [(name, no, i, [line]) for no, (name, lines) in enumerate(sheets.items()) for i, line in enumerate(lines)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)


def _faq(folder, files):
    folder.mkdir(exist_ok=True)
    for old in folder.iterdir():
        if old.name not in files:
            old.unlink()
    for name, qas in files.items():
        (folder / name).write_text(json.dumps({"categories": [{"category": "C", "questions": [
            {"question": q, "answer": a} for q, a in qas]}]}))


def _kb(spark, path):
    return [tuple(r) for r in load_knowledge_base(spark, path).drop("batch").orderBy("ord").collect()]


def test_incremental_builds_equal_full_builds(spark, tmp_path, monkeypatch):
    sheets = {f"S{i}": ["intro", f"What is {i}?", f"Answer {i} 0300-1234567", "How?", f"so {i}"] for i in range(5)}
    faq = {f"{i}.json": [(f"Q{i}?", f"A{i}"), ("How?", "same key"), ("Shared?", f"from {i}")] for i in range(4)}
    processed = []
    original = U.process_changes

    def watched(*a):
        kept, n = original(*a)
        processed.append(n)
        return kept, n

    monkeypatch.setattr("askframe.jobs.process_changes", watched)
    base = str(tmp_path)
    paths = dict(sheet_rows_path=f"{base}/rows", sheet_map_path=f"{base}/map", faq_path=f"{base}/faq/*.json", rebuild=True)

    def both():
        _sheets(spark, f"{base}/rows", sheets)
        _faq(tmp_path / "faq", faq)
        build_knowledge_base(spark, kb_path=f"{base}/a", units_path=f"{base}/units", **paths)
        build_knowledge_base(spark, kb_path=f"{base}/b", **paths)
        got = _kb(spark, f"{base}/a")
        assert got == _kb(spark, f"{base}/b") and got
        return processed[-1]

    spark.createDataFrame([("S1", "One")], "sheet string, product string").write.parquet(f"{base}/map")
    assert both() == 9
    assert both() == 0                                    # nothing changed, rows dealt anew
    sheets["S2"][2] = "Changed answer"
    faq["1.json"][2] = ("Shared?", "changed")
    assert both() == 2
    del faq["0.json"]                                     # the first of "Shared?" goes: another file's row comes first
    faq["00.json"] = [("New?", "at another place")]
    assert both() == 1
    del sheets["S0"]                                      # every later sheet has another number
    assert both() == 4
    faq["0.json"] = [("Q0?", "A0"), ("How?", "same key"), ("Shared?", "from 0")]
    assert both() == 0                                    # a state of before is still stored
    spark.createDataFrame([("S1", "One"), ("S3", "Three")], "sheet string, product string").write.mode("overwrite").parquet(f"{base}/map")
    assert both() == 1                                    # a product name is content, too


def test_settings_are_part_of_the_fingerprint(spark, tmp_path):
    _sheets(spark, str(tmp_path / "rows"), {"S": ["What?", "Yes."]})
    rows, profile = spark.read.parquet(str(tmp_path / "rows")), rules.DEFAULT_PROFILE
    count = lambda skip, name: U.process_changes(spark, str(tmp_path / "u"), rows, None, None, name, skip, profile)[1]
    assert [count([], "w"), count([], "w"), count([], "v"), count(["T"], "w")] == [1, 0, 1, 1]


def test_a_run_that_died_is_not_read(spark, tmp_path, monkeypatch):
    _sheets(spark, str(tmp_path / "rows"), {"S": ["What?", "Yes."], "T": ["How?", "So."]})
    args = (spark, str(tmp_path / "u"), spark.read.parquet(str(tmp_path / "rows")), None, None, "w", [], rules.DEFAULT_PROFILE)
    import askframe.sources.units as module
    with monkeypatch.context() as m:  # dies between the rows and the list of finished units
        calls = []

        def materialize(df):
            calls.append(df)
            if len(calls) == 3:
                raise RuntimeError("died")
            return df.checkpoint()
        m.setattr(module, "materialize", materialize)
        with pytest.raises(RuntimeError, match="died"):
            U.process_changes(*args)
    assert (tmp_path / "u" / "rows").exists() and not (tmp_path / "u" / "done").exists()
    kept, n = U.process_changes(*args)
    assert n == 2 and kept.count() == 2
