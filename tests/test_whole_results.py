"""Results that leave out no row or column of the whole job."""

import random
from collections import Counter, defaultdict

from photoloom.operators import dedupe, reports
from photoloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_theme_matrix_counts_every_category(spark):
    rows = [("Sea", "Landscape", "a"), ("sea", "LANDSCAPE", "b"), ("sea", "", "c"), ("sea", "", None), ("hill", " Wildlife", "d"), ("hill", None, "e"), ("none", None, "f")]
    df = spark.createDataFrame(rows, "theme_name string, primary_master_category string, file string")
    got = {r["raw_theme"]: (r["Landscape"], r["Wildlife"], r["extras"], r["total"]) for r in reports.theme_matrix_whole(df).collect()}
    assert got == {"sea": (1, 0, {"LANDSCAPE": 1, "": 1}, 3), "hill": (0, 0, {" Wildlife": 1}, 1)}


def test_theme_matrix_over_a_whole_table(spark):
    want, images = defaultdict(Counter), catalogue.gallery(spark, SF)
    for r in images.select(reports.normalize(images["theme_name"]).alias("t"), "primary_master_category", "file").where("primary_master_category is not null").collect():
        want[r[0]][r[1]] += r[2] is not None
    got = {r["raw_theme"]: r for r in catalogue.theme_matrix_whole(spark, SF).collect()}
    assert set(got) == set(want)
    for t, r in got.items():
        own = {c: r[c] for c in reports.CATEGORIES if r[c]} | r["extras"]
        assert {c: n for c, n in own.items() if n} == {c: n for c, n in want[t].items() if n} and r["total"] == sum(want[t].values())
    assert any(r["extras"] for r in got.values())


def test_union_of_years_has_every_row(spark):
    images = catalogue.gallery(spark, SF)
    got = {r["year"]: (r["n"], r["n_thumbs"]) for r in catalogue.union_years_whole(spark, SF).collect()}
    assert sum(n for n, _ in got.values()) == images.count()
    none = images.where("year is null")
    assert got.pop(None) == (none.count(), none.where("thumb is not null").count()) and none.count() > 0
    assert got == {r["year"]: (r["n"], r["n_thumbs"]) for r in catalogue.union_years(spark, SF).collect()}


def test_greedy_selection_of_a_long_series(spark):
    """Each hash is near the next only, so rounds settle two rows each; 500 rows need more than 200 rounds."""
    rnd, h, recent, series = random.Random(1), 0, [], []
    for _ in range(500):
        series.append(h)
        flips = rnd.sample([b for b in range(256) if b not in recent], 3)
        recent = (recent + flips)[-60:]
        h ^= sum(1 << b for b in flips)
    kept = []
    for i, x in enumerate(series):
        if all((x ^ series[k]).bit_count() > 5 for k in kept):
            kept.append(i)
    assert 240 <= len(kept) <= 260
    words = lambda x: [w - (1 << 64) if (w := x >> 64 * k & (1 << 64) - 1) >> 63 else w for k in range(4)]
    df = spark.createDataFrame([(i, words(x)) for i, x in enumerate(series)], "photo_id long, phash array<long>")
    assert sorted(r["photo_id"] for r in dedupe.greedy_unique(df, "photo_id", "photo_id", "phash").collect()) == kept
    some = df.where("photo_id < 14")
    assert sorted(r["photo_id"] for r in dedupe.greedy_unique(some, "photo_id", "photo_id", "phash", last_edges=0).collect()) == [i for i in kept if i < 14]


def test_review_page_has_500_cards(spark):
    rows = catalogue.review_page_whole(spark, SF).collect()
    images = reports.review_rows(catalogue.gallery(spark, SF), "image_id")
    sizes = Counter((r[0], r[1]) for r in images.select("review_bucket", "year").collect())
    assert Counter((r["review_bucket"], r["year"]) for r in rows) == {k: min(n, 500) for k, n in sizes.items()} and len(rows) > 20 * len(sizes)
    first = {tuple(r) for r in catalogue.review_page(spark, SF).collect()}
    assert {tuple(r) for r in rows if r["card"] <= 20} == first


def test_every_query_has_its_scores(spark):
    rows = catalogue.search_score_map(spark, SF).collect()
    assert all(r["scores"] == {r["query_id"]: r["score"]} for r in rows)
    assert {q for r in rows for q in r["scores"]} == {r["query_id"] for r in catalogue.words_queries(spark, SF).collect()}


def test_diagnostics_have_examples_and_categories_counts(spark):
    images = catalogue.gallery(spark, SF)
    rows = catalogue.mapping_diagnostics_whole(spark, SF).collect()
    plain = catalogue.mapping_diagnostics(spark, SF)
    assert Counter(tuple(r[c] for c in plain.columns) for r in rows) == Counter(tuple(r) for r in plain.collect())
    assert all(len(r["example_images"]) == min(8, r["image_count"]) for r in rows) and any(r["assigned_master_category"] is None for r in rows)
    want = Counter(r[0] for r in images.select("primary_master_category").collect() if r[0] is not None)
    assert {r[0]: r[1] for r in catalogue.category_counts(spark, SF).collect()} == want
