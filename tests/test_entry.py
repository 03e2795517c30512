import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).parents[1]


def test_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_core_does_not_import_the_optional_part():
    for f in (REPO / "photoloom").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "photoloom.llm" not in f.read_text(), f


def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "period", "row_id"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
