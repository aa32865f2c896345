"""Session helpers: a tuned builder and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # 128 MB splits keep a scan task's working set small at any table size.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # checkpoint files of frames that are no longer referenced are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # task slots already use every core: one BLAS thread per Python worker avoids oversubscription
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def build_session(master: str | None = None, app_name: str = "askframe",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    # listing many small files (upload folders, stream batches) uses a few tasks, not one per file
    conf["spark.sql.sources.parallelPartitionDiscovery.parallelism"] = str(
        8 * (shuffle_partitions or 8))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIP_LOCK = threading.Lock()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master  # "local-cluster" has executors of its own: not local
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Taken from the context or ``spark.checkpoint.dir``.  Only a local-mode
    session without one gets a fresh folder under the system temp directory;
    on a cluster a missing setting is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running")
    path = tempfile.mkdtemp(prefix="askframe-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of this application's scratch folder, in the shared checkpoint folder.

    The scratch folder holds intermediate tables; the driver's file system
    client deletes it when the application ends.
    """
    app = spark.sparkContext.applicationId
    with _SHIP_LOCK:
        if app not in _SCRATCH:
            root = f"{checkpoint_dir(spark).rstrip('/')}/askframe-{app}-{uuid.uuid4().hex[:12]}"
            hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(hpath)
            fs.deleteOnExit(hpath)
            _SCRATCH[app] = root
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for driver-side existence checks."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


LISTING_KEY, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 64


def listing_tasks(spark: SparkSession) -> int:
    """Tasks that list files: four for each core or ``LISTING_TASKS``; Spark's own bound is one for each path, up to 10,000."""
    return min(max(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism), int(spark.conf.get(LISTING_KEY)))


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Frames read inside look their files up in ``listing_tasks`` tasks."""
    old = spark.conf.get(LISTING_KEY)
    spark.conf.set(LISTING_KEY, str(listing_tasks(spark)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_KEY, old)


# Rows of one Arrow batch handed to a Python function: whole texts, so a batch stays at a few MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory does not grow with its task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``askframe`` importable in the Python workers, once per Spark application.

    Functions run by ``mapInPandas``/``applyInPandas`` refer to this package; the
    workers of a cluster (or of a driver started from another folder) do not have
    it on their path.  The package sources are zipped and added with
    ``SparkContext.addPyFile`` (what ``--py-files`` does), so every executor
    receives them from the driver.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIP_LOCK:
        if app in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(pkg_dir)
        zpath = os.path.join(tempfile.mkdtemp(prefix="askframe-pyfiles-"), "askframe.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(pkg_dir):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zpath)
        _SHIPPED.add(app)
