"""Helpers the tests import (a module of its own: ``conftest`` names several files)."""


def one(spark, col, value, schema="x string"):
    """Evaluate a column expression on a single value."""
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]
