"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from planespark.jobs import registry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_without_training_data_operators(tmp_path):
    """A copy without the operators' folders: the registry of the rest is whole, whether or not the pipeline's file is there."""
    for kept in (False, True):
        copy = tmp_path / str(kept)
        shutil.copytree(ROOT, copy, ignore=lambda d, names: [x for x in names if x in ("llm", ".git", "__pycache__") or (x == "corpus_pipeline.py" and not kept)])
        shown = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
        assert shown.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
