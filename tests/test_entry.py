"""The entry module: it imports with and without the training-data subpackage, and its parts agree."""

from __future__ import annotations

import subprocess
import sys
import shutil

from support import DATA, ROOT


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


def test_flagship_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and rows[0]["steps"]


def test_it_works_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")})


def test_data_is_where_the_tests_expect_it():
    import os

    assert os.path.isdir(DATA)
