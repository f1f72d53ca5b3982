"""The package reaches the Python workers of a session that knows nothing of it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", contract.queries()["supcon_loss"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, text=True,
                          capture_output=True, timeout=180)
    assert "rows 10" in done.stdout, done.stderr[-2000:]
