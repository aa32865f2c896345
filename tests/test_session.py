import os
import subprocess
import sys

from askframe.session import checkpoint_dir, local_path, scratch_path, ship_package


def test_checkpoint_and_scratch_folders(spark):
    base = checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()     # the session's setting is used, not replaced
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and os.path.dirname(a) == os.path.dirname(b)
    assert a.startswith(f"{base.rstrip('/')}/askframe-{spark.sparkContext.applicationId}-") and "/x-" in a
    assert local_path("file:///tmp/a") == "/tmp/a"


def test_ship_package_once(spark):
    ship_package(spark)
    before = len(spark.sparkContext._python_includes or [])
    ship_package(spark)
    assert len(spark.sparkContext._python_includes or []) == before


def test_scratch_folder_goes_with_the_application(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = ("from pyspark.sql import SparkSession\nfrom askframe.session import scratch_path\n"
              "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
              f".config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
              "p = scratch_path(s, 'x')\ns.range(3).write.parquet(p)\nprint('ROWS', s.read.parquet(p).count())\ns.stop()\n")
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in out.stdout, out.stderr[-1500:]
    left = [f for f in tmp_path.rglob("*") if f.is_file() and f.suffix == ".parquet"]
    assert left == []
