"""The entry without the training-data subpackage, with and without its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(o) <= set(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    shutil.copytree(ROOT / "reportloom", tmp_path / "reportloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
