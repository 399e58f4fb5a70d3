"""Operators with a model in a session whose Python workers can't import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
sys.path.insert(0, {REPO!r})
from rillworks.llm import queries
def lacks(rows):
    try:
        import rillworks
    except ImportError:
        return iter([1])
    return iter([0])
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacks).sum() == 1
print("rows", *(queries.QUERIES[q](spark, "/root/testdata/sf0.001").count() for q in ("op1_decontaminate", "op2_toxicity", "op9_language_id", "op8_url_filter", "op10_substring_dedup", "op11_centroid_clusters", "op12_secret_scan", "op13_periodic_runs")))
"""


def test_models_travel_by_value(tmp_path):
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=300)
    line = [x for x in said.stdout.splitlines() if x.startswith("rows")]
    assert line and line[0].split()[2:4] == ["200", "200"], said.stderr[-3000:]
