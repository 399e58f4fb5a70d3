"""The entry point, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm(tmp_path):
    for x in ("rillworks", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{x}") else shutil.copy)(f"{REPO}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "rillworks" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.split()[1:] == ["False", "False"], said.stderr
