"""Without the folders of the training-data operators the entry point still gives all other queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; print(sorted(n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'))"


def test_queries_without_the_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "r" / name).unlink(missing_ok=True)
        run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r")})
        assert run.returncode == 0, run.stderr
        assert run.stdout.strip() == "[]"
