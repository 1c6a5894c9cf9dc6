"""The entry module, with and without the optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "rollsmith", tmp_path / "rollsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, operators, pipeline = said.stdout.split()
    assert int(n) > 200 and operators == "False" and pipeline == "False"


def test_a_broken_part_is_not_passed_over(tmp_path):
    shutil.copytree(ROOT / "rollsmith", tmp_path / "rollsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "rollsmith" / "llm").mkdir()
    (tmp_path / "rollsmith" / "llm" / "__init__.py").touch()
    for text, fails in (("import a_library_that_is_not_here\nQUERIES, ORACLES = {}, {}", False), ("from rollsmith.llm import missing", True), ("import rollsmith.llm.missing", True)):
        (tmp_path / "rollsmith" / "llm" / "queries.py").write_text(text)
        said = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
        assert (said.returncode != 0) is fails, said.stderr


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "rollsmith").rglob("*.py"):
        if "llm" not in path.parts:
            assert "rollsmith.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
