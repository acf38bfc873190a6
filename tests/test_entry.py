from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT


def test_entry_is_read_without_a_session():
    """Query names can be listed before any Spark session exists, and all SQL belongs to a query."""
    said = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    run = subprocess.run([sys.executable, "-B", "-c", said], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout) > 60, run.stderr


def test_base_queries_without_the_subpackage(tmp_path):
    """The training-data operators can be taken out, or fail to import, and all other queries are still there."""
    import shutil

    for name in ("procurelake", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    said = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len([q for q in e.queries() if q.startswith('op') and q[2].isdigit()]), len(e.queries()))"
    count = lambda: subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120).stdout.split()
    (tmp_path / "procurelake/llm/words.py").unlink(missing_ok=True)
    broken = count()
    shutil.rmtree(tmp_path / "procurelake/llm", ignore_errors=True)
    gone = count()
    assert broken == gone and gone[0] == "0" and int(gone[1]) > 60
