import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from photoloom.operators.integrity import Reference, orphan_references, orphan_report

T0 = datetime(2024, 1, 1)
CHILD, PARENT = "key string, at timestamp_ntz, row_id long", "key string, begin timestamp_ntz, until timestamp_ntz, row_id long"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def frames(spark, children, parents):
    c = [(k, at(t), i) for i, (k, t) in enumerate(children)]
    p = [(k, at(b), at(u), i) for i, (k, b, u) in enumerate(parents)]
    return Reference("r", spark.createDataFrame(c, CHILD), spark.createDataFrame(p, PARENT))


def brute(children, parents):
    lost = []
    for i, (k, t) in enumerate(children):
        own = [(b, u) for q, b, u in parents if q == k and b is not None]
        if k is not None and not any(t is not None and b <= t and (u is None or u > t) for b, u in own):
            lost.append((i, any(t is not None and b <= t for b, _ in own)))
    return sorted(lost)


def found(ref):
    return sorted((r["row_id"], r["began"]) for r in orphan_references([ref]).collect())


def test_cases(spark):
    children = [("a", 5), ("a", 1), ("a", 9), ("b", 3), (None, 3), ("c", None), ("a", 2), ("a", 8), ("a", 5)]
    parents = [("a", 2, 8), ("c", 1, None), ("b", None, None), ("b", 4, None), (None, 0, None)]
    ref = frames(spark, children, parents)
    assert found(ref) == brute(children, parents)
    report = {(r["period"], r["reason"]): r["n_rows"] for r in orphan_report([ref]).collect()}
    assert report == {("2024-01", "late"): 2, ("2024-01", "deleted"): 2, (None, "late"): 1}


@pytest.mark.parametrize("seed", range(2))
def test_hot_key_over_many_slices(spark, seed):
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(20)}"
    parents = [(key(), b := rnd.randrange(100), rnd.choice([None, b + 1, b + 5]) if rnd.random() < 0.9 else b) for _ in range(40)]
    parents = [(k, b, u if k != "hot" or u is not None else b + 2) for k, b, u in parents]
    children = [(key(), rnd.randrange(110)) for _ in range(600)]
    assert found(frames(spark, children, parents)) == brute(children, parents)


def test_several_references_empty_tables_and_extra_columns(spark):
    none = frames(spark, [], [])
    assert found(none) == []
    some = frames(spark, [("a", 1), ("a", 1)], [])
    assert found(some) == [(0, False), (1, False)]
    wide = Reference("w", some.child.withColumn("slice", F.lit(1)).withColumn("until", F.lit("x")), none.parent.withColumn("at", F.lit(1)))
    both = orphan_references([some, wide]).collect()
    assert sorted((r["reference"], r["row_id"]) for r in both) == [("r", 0), ("r", 1), ("w", 0), ("w", 1)]


def test_times_far_from_now(spark):
    """9999-12-31 as the sign for still valid, years before 1677 and after 2262, and single microseconds."""
    day, us = datetime, timedelta(microseconds=1)
    children = [("a", day(2024, 1, 1), 0), ("a", day(1500, 1, 1), 1), ("a", day(1499, 12, 31, 23, 59, 59, 999999), 2), ("b", day(2999, 7, 1), 3), ("b", day(3000, 1, 1), 4), ("b", day(3000, 1, 1) - us, 5)]
    parents = [("a", day(1500, 1, 1), day(9999, 12, 31), 0), ("b", day(1, 1, 1), day(3000, 1, 1), 1)]
    ref = Reference("r", spark.createDataFrame(children, "key string, at timestamp_ntz, row_id long"), spark.createDataFrame(parents, PARENT))
    assert {r["row_id"]: (r["at"], r["began"]) for r in orphan_references([ref]).collect()} == {2: (children[2][1], False), 4: (children[4][1], True)}
    assert {(r["period"], r["reason"]) for r in orphan_report([ref]).collect()} == {("1499-12", "late"), ("3000-01", "deleted")}
