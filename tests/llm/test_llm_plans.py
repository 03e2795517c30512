"""Plans of the dealt problems' queries: no products, no Python row by row, and what is read."""

import re

import pytest

from photoloom.llm import queries

QUERIES = queries.queries()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_and_no_row_at_a_time_python(spark, monkeypatch, name):
    """Of the plans of the results and of every table written on the way."""
    from photoloom.session import Workspace

    plans, write = [], Workspace.write

    def noted(self, df, label, partition_by=None):
        plans.append(plan(df))
        return write(self, df, label, partition_by)

    monkeypatch.setattr(Workspace, "write", noted)
    plans.append(plan(QUERIES[name](spark, SF)))
    for text in plans:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), text


@pytest.mark.parametrize("name, columns", [("p7_ids", {"doc_id", "text"}), ("p8_found", {"doc_id", "text"}), ("p9_found", {"doc_id", "text"})])
def test_texts_are_read_once_and_not_shuffled(spark, name, columns):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and text.count("FileScan parquet") == 1
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text)[1])) == columns


def test_ranking_is_limited_before_the_shuffle(spark):
    assert plan(QUERIES["p1_found"](spark, SF)).count("WindowGroupLimit") == 2
