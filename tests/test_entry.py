"""The entry points on a copy of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    return [set(line.split()) for line in done.stdout.splitlines()[-2:]]


def test_without_the_operators(tmp_path):
    core = tmp_path / "core"
    shutil.copytree(ROOT, core, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "tests"))
    queries, oracles = names(core)
    assert len(queries) > 80 and not any(q.startswith("op") or q == "pipeline" for q in queries) and oracles <= queries
    (core / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(core) == [queries, oracles]
