import random

import pytest
from pyspark.sql import functions as F

from photoloom.llm import components
from photoloom.llm.components import connected_components, link_groups
from photoloom.session import Workspace


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in list(parent)}


def run(spark, edges, **more):
    df = spark.createDataFrame(edges, "x long, y long")
    got = [(r["vertex"], r["component"]) for r in connected_components(df, "x", "y", **more).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("cell_edges", [4, 1 << 16])
def test_chains_hubs_and_noise(spark, cell_edges):
    rnd = random.Random(1)
    chain = list(range(1000, 1120))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(i, i + 1) for i in range(120)] + [(5000, i) for i in range(5001, 5100)]
    edges += [(rnd.randrange(6000, 6100), rnd.randrange(6000, 6100)) for _ in range(60)]
    edges += [(7, 7), (None, 3), (9000, None), (2, 1), (1, 2), (-4, 1 << 60)]
    assert run(spark, edges, cell_edges=cell_edges) == brute(edges)


def test_edges_and_rounds(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1), (None, None)]) == {}
    with pytest.raises(RuntimeError):
        run(spark, [(i, i + 1) for i in range(200)], cell_edges=1, max_rounds=2)


def test_link_groups(spark):
    records = spark.createDataFrame([(5, "a"), (3, "a"), (9, "b"), (1, "c"), (2, "c"), (8, None), (7, "d"), (6, "e")], "id long, place string")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "missing"), (None, "e"), ("missing", "e"), ("gone", "missing")], "p string, q string")
    got = sorted((r["group_id"], r["id"]) for r in link_groups(records, "id", "place", links, "p", "q").collect())
    assert got == [(3, 3), (3, 5), (3, 9)]
    assert link_groups(records.limit(0), "id", "place", links, "p", "q").count() == 0
    assert link_groups(records, "id", "place", links.limit(0), "p", "q").count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_hubs_are_dealt_out(spark, monkeypatch, most):
    """A hub's cells are split into parts, whether they are broadcast or joined."""
    monkeypatch.setattr(components, "MAX_BROADCAST", most)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1040)] + [(399, 1000), (5000, 5001)]
    df = spark.createDataFrame(edges, "a long, b long")
    work = Workspace(spark, "t")
    cells = df.selectExpr("a as u", "b as v", "0 as row", "int(b % 2) as col")
    parted = components._parted(cells, len(edges), 8, work)
    sizes = [r["n"] for r in parted.groupBy("row", "col", "part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == len(edges) and max(sizes) < 40
    got = {r["vertex"]: r["component"] for r in components.connected_components(df, "a", "b", cell_edges=8).collect()}
    assert got == {**dict.fromkeys([*range(400), *range(1000, 1041)], 0), 5000: 5000, 5001: 5000}
