"""The dealt problems' queries with SQL against DuckDB, on whole tables."""

import oracle
import pytest

from photoloom.llm import queries

QUERIES, TEXTS = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(TEXTS))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_agrees_with_sql(spark, name, sf):
    assert oracle.compare(spark, name, QUERIES[name], TEXTS[name], f"/root/testdata/{sf}") == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TEXTS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
