import math
import random

import pytest
from pyspark.sql import functions as F

from photoloom.llm.topn import top_n_per_group

SCHEMA = "g string, h int, a int, b double, id long"


def brute(rows, n):
    usable = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x
    last = lambda x: (1, 0) if usable(x) is None else (0, -x)
    groups = {}
    for g, h, a, b, i in rows:
        if g is not None and h is not None:
            groups.setdefault((g, h), []).append((last(a), last(b), i))
    return sorted(i for x in groups.values() for _, _, i in sorted(x)[:n])


def run(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(r["id"] for r in top_n_per_group(df, ["g", "h"], ["a", "b"], "id", n, **more).collect())


@pytest.mark.parametrize("most", [0, 2, 100_000])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, most):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    rows = [(pick("hot", "hot", "x", "y", None), pick(1, 1, 2, None), pick(None, -5, 0, 7, 8, 8, 9, 10**6), pick(None, float("nan"), -1.5, 0.0, 0.25, 0.25, 0.9), i) for i in range(800)]
    for n in (1, 3):
        assert run(spark, rows, n, most_broadcast=most) == brute(rows, n)


def test_edges(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [("x", 1, 1, 1.0, 1)], 0) == []
    same = [("x", 1, 5, 0.5, i) for i in range(50)]
    assert run(spark, same, 3) == [0, 1, 2]
    assert run(spark, [("x", 1, None, None, i) for i in range(9)], 3) == [0, 1, 2]
    assert run(spark, [("x", 1, a, math.inf, i) for i, a in enumerate((1, 2, 3, 4))], 2) == [2, 3]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([("x", 1, 5, 0.5, 7)], SCHEMA).withColumn("n", F.lit("kept")).withColumn("k", F.lit(1))
    got = top_n_per_group(df, ["g", "h"], ["a", "b"], "id", 3).first()
    assert got["n"] == "kept" and got["rank"] == 1
    got = top_n_per_group(df.withColumn("rank", F.lit("own")), ["g", "h"], ["a", "b"], "id", 3).first()
    assert got["rank"] == "own" and got["rank_"] == 1


def test_more_wanted_than_spark_limits_by_itself(spark):
    """Ties of one large group are ranked in parts before they meet."""
    rows = [("hot", 1, i % 2, 0.5, i) for i in range(5000)] + [("x", 1, 1, 0.5, -1)]
    assert run(spark, rows, 1500) == brute(rows, 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = top_n_per_group(df, ["g", "h"], ["a", "b"], "id", 1500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") + plan.count("Window[") >= 2 and "WindowGroupLimit" not in plan


@pytest.mark.parametrize("kind", ["int", "long", "double"])
def test_neighbouring_first_scores_come_before_the_second_score(spark, kind):
    """A larger first score wins whatever the second one is, also where both scores are close or very large."""
    rnd = random.Random(5)
    rows = [("x", 1, rnd.choice([76, 77, 78, 32766, 32767, 32768, 32769, 2_000_000_000, 2_000_000_001, -77, -78]), rnd.random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a", F.col("a").cast(kind))
    for n in (3, 30, 100, 200, 290):
        assert sorted(r["id"] for r in top_n_per_group(df, ["g", "h"], ["a", "b"], "id", n).collect()) == brute(rows, n)
