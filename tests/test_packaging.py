"""A worker that does not have the repository on its path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import functions as F
from lotwatch import build_session
from lotwatch.operators.embedding import embed_passages
from lotwatch.session import ship_package
spark = build_session("away", spark__master="local[2]", spark__ui__enabled="false")
ship_package(spark)
print("rows", spark.createDataFrame([("a b",)], "t string").select(embed_passages(F.col("t"))).count())
spark.createDataFrame([("a b",)], "t string").select(embed_passages(F.col("t"))).collect()
spark.stop()
"""


def test_the_shipped_package_is_enough(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows 1" in done.stdout, done.stderr[-2000:]
