"""Plans of the core queries: what reaches the scan, and what must not be in them."""

import re

import pytest

from photoloom.plans import archive, catalogue

QUERIES = archive.queries() | catalogue.queries()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_and_no_row_at_a_time_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.flagged_rows(spark, SF))
    assert "IsNotNull(review_flags)" in text
    scan = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert set(re.findall(r"(\w+):", scan)) == {"image_id", "year", "primary_master_category", "review_flags"}


@pytest.mark.parametrize("name", ["audit_sample", "review_page", "search_topk"])
def test_ranking_is_limited_before_the_shuffle(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("WindowGroupLimit") == 2
