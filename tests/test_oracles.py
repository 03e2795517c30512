"""Every core query with SQL against DuckDB, on whole tables."""

import oracle
import pytest

from photoloom.plans import archive, catalogue

SF = "/root/testdata/sf0.01"
QUERIES = archive.queries() | catalogue.queries()
TEXTS = archive.oracle_sql() | catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_agrees_with_sql(spark, name):
    assert oracle.compare(spark, name, QUERIES[name], TEXTS[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TEXTS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
