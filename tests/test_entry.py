"""The driver's module works with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') for k in q))"


def said(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "folioforge", tmp_path / "folioforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, ops = said(tmp_path)
    assert int(n) >= 40 and ops == "False"


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and "status" in df.columns
