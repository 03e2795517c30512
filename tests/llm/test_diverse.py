import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from photoloom.llm.diverse import CFTree, _vectors, cut, varied_subset, ward_merges
from photoloom.llm.queries import p5_subset

SF = "/root/testdata/sf0.01"


def test_tree_keeps_sums_and_its_bound():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    tree = CFTree(4, 200)
    for k in range(0, 3000, 250):
        v = x[k : k + 250]
        tree.add(np.ones(250), v, (v**2).sum(1))
    n, ls, ss = tree.features()
    assert len(n) == tree.entries <= 200 and len(n) > 20
    assert abs(n.sum() - 3000) < 1e-6 and np.allclose(ls.sum(0), x.sum(0)) and np.isclose(ss.sum(), (x**2).sum())


@pytest.mark.parametrize("size", [1, 25, 500])
def test_tree_merges_only_equal_points_while_there_is_room(size):
    tree = CFTree(2, 1000)
    for k in range(0, 500, size):
        v = np.array([[j % 50, (j % 50) ** 2] for j in range(k, k + size)], float)
        tree.add(np.ones(size), v, (v**2).sum(1))
    # A point may reach another leaf than its equal once nodes have split, which costs an entry and no sum.
    assert 50 <= tree.entries <= 55 and tree.features()[0].sum() == 500


def brute_ward(n, x, k):
    groups = [[i] for i in range(len(x))]
    mean = lambda g: np.average(x[g], axis=0, weights=n[g])
    while len(groups) > k:
        cost = lambda a, b: n[a].sum() * n[b].sum() / (n[a].sum() + n[b].sum()) * ((mean(a) - mean(b)) ** 2).sum()
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(3))
def test_ward_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, x = rng.integers(1, 9, 25).astype(float), rng.standard_normal((25, 3))
    merges = ward_merges(n, x)
    for k in (1, 4, 10, 25):
        g = cut(merges, 25, k)
        assert {frozenset(np.flatnonzero(g == i)) for i in set(g)} == brute_ward(n, x, k)


def subset(spark, rows, sizes, **more):
    df = spark.createDataFrame(rows, "id long, a string, b int").withColumn("request_id", F.lit("clash"))
    got = varied_subset(df, "id", {"a": (F.col("a"), 1.0), "b": (F.col("b"), 0.5)}, sizes, **more).collect()
    return {r: sorted(x["id"] for x in got if x["request_id"] == r) for r in sizes}


def test_sizes_fill_up_and_edges(spark):
    rows = [(i, "hot", 1) for i in range(400)] + [(1000 + i, f"v{i}", i) for i in range(9)] + [(2000, None, None)]
    got = subset(spark, rows, {1: 5, 2: 11, 3: 30, 4: 1000, 5: 0})
    assert [len(got[r]) for r in (1, 2, 3, 4, 5)] == [5, 11, 30, 410, 0]
    assert all(len(set(x)) == len(x) for x in got.values())
    assert got[2] == [0, *range(1000, 1009), 2000]  # one of each combination
    assert got[3] == [*range(20), *range(1000, 1009), 2000]
    assert len([i for i in got[1] if i < 400]) <= 1  # the large group doesn't fill the subset
    assert subset(spark, [], {1: 5}) == {1: []}
    assert len(subset(spark, rows, {1: 10**6})[1]) == 410


def test_entries_stay_within_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 3))
    tree = CFTree(3, 10**6, 0.5)
    for k in range(0, 2000, 400):
        tree.add(np.ones(400), x[k : k + 400], (x[k : k + 400] ** 2).sum(1))
    n, ls, ss = tree.features()
    assert n.sum() == 2000 and len(n) < 1500 and (ss / n - (ls**2).sum(1) / n**2 <= 0.25 + 1e-9).all()


def test_representatives_are_nearest_to_their_centres(spark):
    """With a leaf entry for each combination, groups, centres and representatives are those of Ward linkage."""
    rng = np.random.default_rng(7)
    rows = [(i, f"a{rng.integers(5)}", int(rng.integers(9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b int")
    got = {r["id"] for r in varied_subset(df, "id", {"a": (F.col("a"), 1.0), "b": (F.col("b"), 0.5)}, {1: 7}).collect()}
    table = df.select(F.min("id").over(Window.partitionBy("a", "b")).alias("id"), F.xxhash64(F.lit(0), F.lit(False), "a").alias("h0"), F.xxhash64(F.lit(1), F.lit(False), "b").alias("h1")).distinct().toPandas()
    v, ids = _vectors([table["h0"].to_numpy(), table["h1"].to_numpy()], [1.0, 0.5]), table["id"].to_numpy()
    g = cut(ward_merges(np.ones(len(v)), v), len(v), 7)
    wanted = set()
    for k in range(7):
        centre = v[g == k].mean(0)
        d = ((v - centre) ** 2).sum(1).round(9)
        wanted.add(min((far, i) for far, i in zip(d, ids))[1])
    assert len(got) == 7 and len(got & wanted) >= 6  # equal heights may be merged in another order


def test_subsets_larger_than_one_linkage(spark):
    rows = [(i, f"a{i % 40}", i % 31) for i in range(3000)]
    got = subset(spark, rows, {1: 300, 2: 25, 3: 1000}, direct=40, leaf_entries=60)
    assert [len(set(got[r])) for r in (1, 2, 3)] == [300, 25, 1000]
    assert len({i % 40 for i in got[1]}) == 40 and len({i % 31 for i in got[1]}) >= 28


def test_summaries_of_many_partitions(spark):
    rows = [(i, f"a{i % 37}", i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a string, b int").repartition(20)
    got = varied_subset(df, "id", {"a": (F.col("a"), 1.0), "b": (F.col("b"), 1.0)}, {1: 40}, leaf_entries=64).collect()
    assert len({r["id"] for r in got}) == 40
    again = varied_subset(df, "id", {"a": (F.col("a"), 1.0), "b": (F.col("b"), 1.0)}, {1: 40}, leaf_entries=64).collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}


def test_covers_the_gallery(spark):
    images = spark.read.parquet(f"{SF}/master_gallery_images.parquet")
    picked = p5_subset(spark, SF).join(images, "image_id")
    c = F.lower(F.trim("primary_master_category"))
    got = {r["request_id"]: r for r in picked.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(c).alias("c"), F.countDistinct("year").alias("y"), F.countDistinct("year", "cluster_id").alias("k")).collect()}
    assert {r: x["n"] for r, x in got.items()} == {1: 20, 2: 100, 3: 500, 4: 2000}
    assert got[1]["c"] >= 9 and got[2]["c"] >= 10 and got[1]["y"] >= 8 and got[2]["y"] >= 18 and got[1]["k"] >= 18 and got[2]["k"] >= 75
