"""The driver's contract: names, and a library that works without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def _names(folder):
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True, timeout=300)
    queries, sql = done.stdout.strip().splitlines()
    return set(queries.split()), set(sql.split())


def test_library_stands_without_the_training_data_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    queries, sql = _names(copy)  # the pipeline's file is there, its operators are not
    assert queries and not [x for x in queries | sql if x.startswith("op") or x == "pipeline"]
    (copy / "corpus_pipeline.py").unlink()
    assert _names(copy) == (queries, sql)


def test_sql_belongs_to_queries():
    queries, sql = _names(ROOT)
    assert sql <= queries
