"""The entry points where the optional parts are absent."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from millrace.catalogue import QUERIES


@pytest.mark.parametrize("without", [["millrace/llm"], ["millrace/llm", "corpus_pipeline.py"]])
def test_entry_without_the_operators(tmp_path, without):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    shutil.copytree(ROOT / "millrace", copy / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in without:
        if (copy / name).is_file():
            (copy / name).unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2
