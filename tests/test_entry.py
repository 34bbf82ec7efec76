"""The driver contract without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

CALLS = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert "certificates" in found and set(sql) <= set(found)
assert not any(n.startswith("op") or n == "pipeline" for n in found), sorted(found)
"""


@pytest.mark.parametrize("gone", [["certjobs/llm", "tests/llm"], ["certjobs/llm", "tests/llm", "corpus_pipeline.py"]])
def test_rest_works_without_corpus_operators(tmp_path, gone):
    left = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=left)
    for name in gone:
        at = copy / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    subprocess.run([sys.executable, "-c", CALLS], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
