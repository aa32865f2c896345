import __spark_entry__ as E

ROWS_ONLY: set = set()


def own() -> dict:
    """The queries of the package itself; those of the corpus operators have tests of their own."""
    from askframe.plans.catalog import QUERIES
    return dict(QUERIES)


def test_registry_contract():
    q, o = own(), {k: v for k, v in E.oracle_sql().items() if k in own()}
    assert set(q) <= set(E.queries())
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY
    assert len(q) >= 41


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "route", "answer", "blocked", "warning", "n_sources"]
    assert df.count() > 0


def test_each_query_plans_on_smoke_data(spark):
    # every registered query resolves its plan on the smallest tables (streams excluded: they run jobs)
    for key, fn in own().items():
        if key.startswith("stream_"):
            continue
        assert fn(spark, E.SMOKE_DIR).schema is not None, key


def test_no_cross_products_or_row_udfs(spark):
    """No registered query plans a cartesian product, a nested-loop join or a row-at-a-time Python UDF."""
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
    for key, fn in own().items():
        if key.startswith("stream_"):
            continue
        plan = fn(spark, E.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        found = [b for b in banned if b in plan]
        assert not found, (key, found)


def test_loaded_by_path_from_another_folder(tmp_path):
    """The driver may load the entry file by path from any folder; Python workers must still find the package."""
    import subprocess
    import sys
    script = (
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('entry_mod', {E.__file__!r})\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', E.queries()['vec_topk'](s, E.SMOKE_DIR).count())\n")
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
