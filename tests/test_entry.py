"""The entry must import where the optional parts are left out."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_optional_parts(tmp_path, pipeline):
    shutil.copytree(ROOT / "daygrid", tmp_path / "daygrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if pipeline or name != "corpus_pipeline.py":
            shutil.copy(ROOT / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, others = out.stdout.split()
    assert int(n) > 150 and int(sql) > 150 and others == "False"
