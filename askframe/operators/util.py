"""Small shared plan helpers."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint (to the shared checkpoint folder) a frame that several passes read.

    The caller decides: a frame that runs Python code or a search would
    otherwise be computed again by every pass.
    """
    from askframe.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the checkpoint files that ``df`` reads, ahead of the context cleaner; nothing may read them any more.

    What was computed from them must itself be stored.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.length())):
        if leaf.getClass().getSimpleName() == "LogicalRDD" and (stored := leaf.rdd().getCheckpointFile()).isDefined():
            hpath = jvm.org.apache.hadoop.fs.Path(stored.get())
            hpath.getFileSystem(conf).delete(hpath, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark drop shuffle files and checkpoints that nothing refers to; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
