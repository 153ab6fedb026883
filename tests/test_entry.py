import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from meadowlark import queries as core


def test_every_core_query_has_an_oracle():
    assert set(core.queries()) == set(core.oracle_sql())


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_works_without_the_corpus_package(tmp_path):
    """A real copy without the corpus folders and the pipeline still has all core queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "meadowlark", tmp_path / "meadowlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stdout
    assert said.split() == ["True", str(len(core.queries()))]


def test_core_never_imports_the_corpus_package():
    code = "import sys, meadowlark.queries, meadowlark.plans.reports, meadowlark.streaming.reports, meadowlark.sources.sinks; print(any('llm' in m.split('.') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"
