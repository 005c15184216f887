"""Executors need neither the package nor the repository: every corpus query, started
elsewhere without a path to it, writes out its rows."""

import os
import subprocess
import sys

from tests.conftest import SF001


def test_queries_run_from_another_directory(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r} + "/shared").getOrCreate())
import __spark_entry__ as E
names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
assert len(names) == 14
for n in names:
    E.queries()[n](spark, {SF001!r}).write.parquet({str(tmp_path)!r} + "/" + n)
print("DONE", len(names))
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0 and "DONE 14" in out.stdout, out.stderr[-3000:]
