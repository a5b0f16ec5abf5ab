"""The entry module in a copy of the repository without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search_top5' in q and set(e.oracle_sql()) <= set(q), q; print(sum(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [["loomkb/llm", "tests/llm", "corpus_pipeline.py"], ["loomkb/llm", "tests/llm"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"
