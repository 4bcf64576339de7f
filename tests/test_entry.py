"""The driver contract in a copy of the repository without the optional folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
_NAMES = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "logscope", copy / "logscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    ran = subprocess.run([sys.executable, "-c", _NAMES], cwd=copy, capture_output=True, text=True,
                         check=False)
    assert ran.returncode == 0, ran.stderr
    from logscope.workload import REGISTRY

    assert ran.stdout.split() == ["True", str(len(REGISTRY))]
