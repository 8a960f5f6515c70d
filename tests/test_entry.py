import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_imports_without_the_llm_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline'); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_nothing_else_imports_the_llm_part():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text()
