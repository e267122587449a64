"""The repository as a whole: what is left without the corpus part, and names that are defined once."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PARTS = ("laurel", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py")
ASK = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), any(n.startswith('op') or n == 'pipeline' for n in names))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_alone(tmp_path, pipeline):
    for part in PARTS:
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif pipeline or part != "corpus_pipeline.py":
            shutil.copy(source, tmp_path / part)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    number, corpus = done.stdout.split()
    assert int(number) > 100 and corpus == "False"


@pytest.mark.parametrize("path", sorted(str(p.relative_to(ROOT)) for p in ROOT.rglob("*.py") if ".git" not in p.parts))
def test_no_name_is_defined_twice(path):
    tree = ast.parse((ROOT / path).read_text())
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
        names = [n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names))
