"""The driver contract holds without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_llm(tmp_path, with_pipeline):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, sql, pipeline = run.stdout.split()
    assert int(n) >= int(sql) > 40 and pipeline == "False"
