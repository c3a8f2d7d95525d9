from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TINY = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows
    assert {r["match_status"] for r in rows} <= {"matched", "below_threshold"}


def test_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "tilmark"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "tilmark"
    package.mkdir()
    for p in (ROOT / "tilmark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    # the entry module is linked, so it must be found through tmp_path first
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    (tmp_path / "tests").mkdir()
    for p in (ROOT / "tests").glob("*.py"):
        if p.name != "test_entry.py":
            (tmp_path / "tests" / p.name).symlink_to(p)
    some = ["tests/test_text_metrics.py", "tests/test_match_align.py"]
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *some], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stdout[-2000:]
