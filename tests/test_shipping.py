"""A session that starts elsewhere gets the package by ``ship``."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import rillflow
rillflow.ship(spark)
rillflow.ship(spark)
from rillflow.functions import mathtext
print("GOT", [r[0] for r in spark.range(2).selectExpr("concat('boxed ', id) as t").select(mathtext.strip_accents("t")).collect()])
"""


def test_workers_elsewhere_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "GOT ['boxed 0', 'boxed 1']" in done.stdout, done.stderr[-2000:]
