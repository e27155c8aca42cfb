"""The driver's contract, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [("larder/llm",), ("corpus_pipeline.py",), ("larder/llm", "corpus_pipeline.py"), ("larder/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_training_data_operators(tmp_path, gone):
    """A copy of the repository without those folders still gives every other query."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout
    assert "bm25_topk" in found
    assert ("op1_" in found) == ("larder/llm" not in gone and (copy / "larder/llm").exists())
    assert ("'pipeline'" in found) == (not gone[0].startswith("larder") and (copy / "corpus_pipeline.py").exists())
