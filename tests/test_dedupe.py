import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from photoloom.functions.vectors import hamming, hash_bands
from photoloom.operators import dedupe
from photoloom.operators.graph import least_label_components

SCHEMA = "photo_id long, relpath string, size long, width int, height int, taken timestamp_ntz, phash array<long>, content string"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def words(bits):
    return [signed((bits >> (64 * i)) & ((1 << 64) - 1)) for i in range(4)]


def flip(bits, rnd, n):
    for i in rnd.sample(range(256), n):
        bits ^= 1 << i
    return bits


def near_hashes(seed, n=120):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(256) for _ in range(6)]
    while len(out) < n:
        out.append(flip(rnd.choice(out), rnd, rnd.choice([0, 1, 3, 5, 6, 7])))
    return out


def test_bands_lose_nothing(spark):
    rnd = random.Random(1)
    pairs = []
    for _ in range(100):
        a = rnd.getrandbits(256)
        pairs.append((words(a), words(flip(a, rnd, 6))))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = df.select(hamming(F.col("a"), F.col("b")).alias("d"), F.arrays_overlap(hash_bands(F.col("a"), 7), hash_bands(F.col("b"), 7)).alias("meet")).collect()
    assert all(r["d"] == 6 and r["meet"] for r in got)


def test_greedy_is_the_sequential_pass(spark):
    hashes = near_hashes(3)
    kept = []
    for i, h in enumerate(hashes):
        if all((h ^ hashes[j]).bit_count() > 5 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, words(h)) for i, h in enumerate(hashes)] + [(500, None), (501, [1])], "photo_id long, phash array<long>")
    got = sorted(r["photo_id"] for r in dedupe.greedy_unique(df, "photo_id", "photo_id", "phash", 5).collect())
    assert got == kept
    top = [r["photo_id"] for r in dedupe.greedy_unique(df, "photo_id", "photo_id", "phash", 5, top_n=3).collect()]
    assert top == kept[:3]


def test_greedy_differs_from_components(spark):
    a = 0
    b, c = (1 << 5) - 1, (1 << 10) - 1
    df = spark.createDataFrame([(i, words(h | (1 << 200))) for i, h in enumerate((a, b, c))], "photo_id long, phash array<long>")
    assert sorted(r["photo_id"] for r in dedupe.greedy_unique(df, "photo_id", "photo_id", "phash", 5).collect()) == [0, 2]


def photos(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_near_groups_and_an_unset_clock(spark):
    t = datetime(1970, 1, 1)
    rnd = random.Random(5)
    rows = [(i, f"x/{i}a.jpg", 1, 1, 1, t, words(rnd.getrandbits(256)), None) for i in range(300)]
    same = words(7)
    rows += [(1000 + i, f"y/{1000 + i}b.jpg", 1, 1, 1, t, same, None) for i in range(300)]
    rows += [(2000, "z/q.jpg", 1, 1, 1, t + timedelta(seconds=8), words(7 ^ 0b111111 << 100), None), (2001, "z/r.jpg", 1, 1, 1, t + timedelta(seconds=9), same, None)]
    rows += [(3000, "s/IMG 1.jpg", 1, 1, 1, None, words(1 << 90), None), (3001, "t/img-1.arw", 1, 1, 1, None, words(255 << 90 | 1 << 90), None), (3002, "t/img_1.arw", 1, 1, 1, None, None, None)]
    p = photos(spark, rows)
    groups = {r["photo_id"]: r["group_id"] for r in dedupe.near_groups(p).collect()}
    assert {k for k, g in groups.items() if g == 1000} == {1000 + i for i in range(300)} | {2000, 2001}
    assert {k for k, g in groups.items() if g == 3000} == {3000, 3001}
    assert len(groups) == 304
    pairs = dedupe.near_pairs_in_time(p).collect()
    assert {(r["a_id"], r["b_id"]) for r in pairs} == {(1000, 2000), (2000, 2001)}


def test_exact_keepers_excludes_and_set_difference(spark):
    t = datetime(2020, 1, 1)
    h, other = words(1), words(1 << 9)
    rows = [
        (1, "a/dsc1.arw", 9, 60, 40, t, h, "x"), (2, "a/dsc1.jpg", 9, 60, 40, t, h, "x"), (3, "b/dsc1 copy.jpg", 9, 60, 40, t, h, "x"),
        (4, "c/other.jpg", 9, 60, 40, t, None, "y"), (5, "c/big.jpg", 8, 60, 40, t, None, "x"), (6, "c/none.jpg", None, None, None, t, None, None),
        (7, "d/q.jpg", 5, 1, 1, t + timedelta(days=9), other, None), (8, "e/w.jpg", 5, 1, 1, t + timedelta(days=9), other, None),
    ]
    p = photos(spark, rows)
    exact = dedupe.exact_groups(p)
    assert sorted((r["group_id"], r["photo_id"]) for r in exact.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert [tuple(r) for r in dedupe.keepers(exact, p).collect()] == [(1, 2, 3)]
    assert {r["relpath"] for r in dedupe.excludes(exact, p).collect()} == {"a/dsc1.arw", "b/dsc1 copy.jpg"}
    near = dedupe.near_minus_exact(dedupe.near_groups(p), exact)
    assert sorted((r["group_id"], r["photo_id"]) for r in near.collect()) == [(7, 7), (7, 8)]
    none = photos(spark, [])
    assert dedupe.near_groups(none).count() == dedupe.exact_groups(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    ids = list(range(1, 400))
    rnd.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200])) + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["vertex"]: r["component"] for r in least_label_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[v] for v in ids[:200]} == {min(ids[:200])} and {got[1000 + i] for i in range(50)} == {1000}
    assert len(got) == 250


def test_hot_bands_are_split_without_losing_pairs(spark):
    """Nearly blank pictures of one moment share their bands; the pairs are those of all against all."""
    rnd = random.Random(9)
    flips = lambda n: sum(1 << b for b in rnd.sample(range(256), n))
    words = lambda x: [w - (1 << 64) if (w := x >> 64 * k & (1 << 64) - 1) >> 63 else w for k in range(4)]
    hashes = list({flips(rnd.choice([1, 2, 3, 4, 5, 6])) for _ in range(150)})
    rows = [(i, f"dir/a{i % 3}.jpg", datetime(2020, 1, 1, 0, 0, i % 5), words(h)) for i, h in enumerate(hashes)]
    photos = spark.createDataFrame(rows, "photo_id long, relpath string, taken timestamp_ntz, phash array<long>")
    brute = lambda bits, same: {(i, j) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= bits and same(i, j)}
    for hot in (2, 1024):
        assert {(r[0], r[1]) for r in dedupe.near_pairs_in_time(photos, hot=hot).collect()} == brute(6, lambda i, j: True)
        assert {(r[0], r[1]) for r in dedupe.near_pairs_by_stem(photos, hot=hot).collect()} == brute(8, lambda i, j: i % 3 == j % 3)
        kept = []
        for i, x in enumerate(hashes):
            if all((x ^ hashes[k]).bit_count() > 5 for k in kept):
                kept.append(i)
        assert sorted(r[0] for r in dedupe.greedy_unique(photos, "photo_id", "photo_id", "phash", hot=hot).collect()) == kept
