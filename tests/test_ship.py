"""Queries work from any folder: the package reaches the Python workers by itself."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["p5_found"](spark, sys.argv[2]).count(), e.queries()["lz77_ratio"](spark, sys.argv[2]).count())
"""


def test_from_another_folder(data, tmp_path):
    root = str(Path(__file__).parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, root, data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
    assert all(int(x) > 0 for x in run.stdout.split("ROWS")[1].split())
