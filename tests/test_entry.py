import subprocess
import sys
import shutil
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["n_name", "n_orders", "total"] and out.count() > 0


def test_names_agree():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_works_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries())[0])"], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.stdout.split()[0] == "70", said.stderr
