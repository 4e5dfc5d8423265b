"""The driver's contract, with and without the language-model part."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_llm_part(tmp_path):
    for part in ("quern", "__spark_entry__.py"):
        source = ROOT / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q); print(len(q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1] == "True"


def test_nothing_else_imports_the_llm_part():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quern.llm" not in path.read_text() and "from quern import llm" not in path.read_text()
