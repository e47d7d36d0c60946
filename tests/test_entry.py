"""The entry points, with the training-data subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent
CODE = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k[:3] == 'op1' or k == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))"


def copied(tmp_path, drop=()):
    for name in ("__spark_entry__.py", "corpusloom"):
        source, to = ROOT / name, tmp_path / name
        shutil.copytree(source, to, ignore=shutil.ignore_patterns("__pycache__")) if source.is_dir() else shutil.copy(source, to)
    for name in drop:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return tmp_path


def run(folder, code=CODE):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage(tmp_path):
    out = run(copied(tmp_path, ["corpusloom/llm"]))
    n, rest = out.stdout.split(" ", 1)
    assert int(n) > 100 and "[]" in rest and rest.strip().endswith("True"), out.stderr


@pytest.mark.skipif(not (ROOT / "corpusloom" / "llm").is_dir(), reason="no subpackage")
def test_a_missing_library_leaves_the_other_queries(tmp_path):
    folder = copied(tmp_path)
    (folder / "xxhash.py").write_text("raise ImportError('no xxhash', name='xxhash')\n")
    out = run(folder, "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1') for k in e.queries()))")
    assert int(out.stdout.split()[0]) > 100 and "False" in out.stdout and "left out" in out.stderr


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
