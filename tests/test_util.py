from askframe.operators.util import materialize


def test_materialize_cuts_the_plan(spark):
    df = spark.range(0, 100).mapInPandas(lambda it: it, "id long")
    done = materialize(df)
    assert done.count() == 100 and "MapInPandas" not in done._jdf.queryExecution().analyzed().toString()
