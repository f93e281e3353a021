"""The rest stands without the training-data subpackage and the pipeline."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for p in [*(ROOT / "tablescore").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_entry_without_it(tmp_path):
    shutil.copytree(ROOT / "tablescore", tmp_path / "tablescore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_the_rest_of_the_tests_pass_without_it(tmp_path):
    """All other test modules, with the comparisons of queries with their SQL."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".pytest_cache", "test_separation.py")
    for name in ("tablescore", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not pathlib.Path(p).resolve().is_relative_to(ROOT)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *inherited])}
    found = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-3000:]
