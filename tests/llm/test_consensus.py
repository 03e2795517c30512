import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from photoloom.llm.consensus import Field, _align, _profile, best_fields, consensus_text
from photoloom.llm.queries import photo_fields

SCHEMA = "photo_id long, c string, width int, height int, size long, capture_time timestamp_ntz, mtime timestamp_ntz, scanned_at timestamp_ntz"


def day(y, m=1, d=1):
    return datetime(y, m, d)


def test_best_fields(spark):
    rows = [
        (4, "x", 10, 10, 7, day(1999), day(2020), day(2025)),  # before the archive begins
        (2, "x", 100, 1, 0, day(2020), day(2020), day(2026)),  # its own file's time, no size
        (3, "x", 1, 100, 8, day(2027), day(2020), day(2024)),  # after the scan
        (9, "x", None, 500, None, day(2022), day(2023), day(2024)),
        (5, "x", -5, -90, 9, day(2022), day(2023), day(2024)),
        (7, "one", 1, 1, 1, day(2020), day(2021), day(2024)),
        (8, None, 1, 1, 1, day(2020), day(2021), day(2024)),
        (10, "none", 0, 9, -1, None, day(2021), day(2024)),
        (11, "none", None, None, None, None, None, day(2024)),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("group_id", F.lit("clash"))
    got = {r["group_key"]: r for r in best_fields(df, F.col("c"), "photo_id", photo_fields()).collect()}
    assert set(got) == {"x", "none"}
    x = got["x"]
    assert (x["group_id"], x["n_rows"], x["dims_id"], x["size_id"], x["time_id"]) == (2, 5, 2, 4, 5)
    assert (x["width"], x["height"], x["size"], x["capture_time"]) == (100, 1, 7, day(2022))
    assert (got["none"]["dims_id"], got["none"]["size_id"], got["none"]["time_id"], got["none"]["width"]) == (-1, -1, -1, None)
    assert best_fields(df.limit(0), F.col("c"), "photo_id", photo_fields()).count() == 0


def test_records_vote_by_rows_without_trust_and_the_nearest_row_wins(spark):
    """Columns are voted one by one, so the consensus 4 x 3 may be no row's; the nearest existing row comes out."""
    rows = [(i, "g", w, h) for i, (w, h) in enumerate([(4, 9), (4, 9), (4, 3), (5, 3), (6, 3), (4, None), (None, 3), (None, 3)])]
    df = spark.createDataFrame(rows, "id long, g string, w int, h int")
    got = best_fields(df, F.col("g"), "id", [Field("wh", F.lit(True), (), ("w", "h"))]).first()
    assert (got["wh_id"], got["w"], got["h"], got["n_rows"]) == (2, 4, 3, 8)
    got = best_fields(df.where("id <> 2"), F.col("g"), "id", [Field("wh", F.col("w") > 0, (), ("w", "h"))]).first()
    assert (got["wh_id"], got["w"], got["h"]) == (0, 4, 9)
    hot = spark.range(3000).selectExpr("id", "'hot' as g", "int(id % 700) as w", "int(3) as h")
    got = best_fields(hot, F.col("g"), "id", [Field("wh", F.lit(True), (F.col("w"),), ("w", "h"))]).first()
    assert (got["wh_id"], got["w"], got["n_rows"]) == (699, 699, 3000)


def align(a, b):
    return _align(_profile([(list(a), 1)]), list(b), 1)


def test_align():
    assert align("abc", "abc") == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]
    assert align("ac", "axyc") == [(1, 0, "a"), (1, 1, "x"), (1, 2, "y"), (2, 0, "c")]
    assert align("abc", "ac") == [(1, 0, "a"), (3, 0, "c")]
    assert align("", "ab") == [(0, 1, "a"), (0, 2, "b")]


def test_profile_grows_value_by_value():
    assert _profile([(list("ac"), 2), (list("abc"), 1), (list("abd"), 1)]) == [{"a": 4}, {"b": 2}, {"c": 3, "d": 1}]
    assert _profile([]) == []


def plain_consensus(values):
    """The consensus of one small group by the definition, without Spark."""
    firsts = sorted(values.items(), key=lambda x: (-x[1], x[0]))
    profile, total = _profile([(v.split(" "), n) for v, n in firsts[:64]]), sum(n for _, n in firsts[:64])
    votes = {}
    for v, n in values.items():
        at = {(i, k): t for i, k, t in _align(profile, v.split(" "), total)}
        for spot in set(at) | {(i + 1, 0) for i in range(len(profile))}:
            votes.setdefault(spot, Counter())[at.get(spot)] += n
    line = []
    for spot in sorted(votes):
        c = votes[spot]
        c[None] += sum(values.values()) - sum(c.values())
        best, n = max(((t, n) for t, n in c.items() if t is not None), key=lambda x: (x[1], x[0]), default=(None, 0))
        if n > c[None] or (n == c[None] and spot[1] == 0):
            line.append(best)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    return min((edits(line, v.split(" ")), -n, v) for v, n in values.items())


@pytest.mark.parametrize("seed", range(3))
def test_text_against_the_definition(spark, seed):
    rnd = random.Random(seed)
    groups = {}
    for g in range(12):
        base = [rnd.choice("abcdef") for _ in range(rnd.randrange(1, 7))]
        for _ in range(rnd.randrange(2, 100)):
            v = [rnd.choice("abcdef") if rnd.random() < 0.2 else t for t in base for _ in range(rnd.choice([1, 1, 1, 1, 0, 2]))] or ["z"]
            groups.setdefault(f"g{g}", Counter())[" ".join(v)] += 1
    rows = [(g, v) for g, c in groups.items() for v, n in c.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v string")
    got = {r["group_key"]: r["value"] for r in consensus_text(df, F.col("g"), F.col("v"), " ").collect()}
    assert got == {g: plain_consensus(c)[2] if len(c) > 1 else next(iter(c)) for g, c in groups.items()}


def consensus(spark, rows):
    df = spark.createDataFrame(rows, "g string, v string")
    return {r["group_key"]: (r["value"], r["n_values"], r["distance"]) for r in consensus_text(df, F.col("g"), F.col("v")).collect()}


def test_consensus(spark):
    rows = [("a", v) for v in ("2020/05/img 1 copy.jpg", "2020/05/img 1.jpg", "2020/06/img 1.jpg", "old/2020/05/img 1.jpg")]
    rows += [("b", "x"), ("b", "x"), (None, "y"), ("c", None), ("c", " "), ("d", "only one"), ("d", None), ("e", "p q"), ("e", "p r")]
    got = consensus(spark, rows)
    assert got["a"] == ("2020/05/img 1.jpg", 4, 0) and got["b"] == ("x", 1, 0) and got["d"] == ("only one", 1, 0)
    assert got["e"][1] == 2 and set(got) == {"a", "b", "d", "e"}
    assert consensus(spark, []) == {}


def test_votes_count_rows_and_the_closest_value_wins(spark):
    rows = [("a", "k 1 z")] * 3 + [("a", "k 2 y")] * 2 + [("a", "m 2 z")] * 2
    value, n, distance = consensus(spark, rows)["a"]  # the consensus is "k 2 z", one edit from each
    assert (value, n, distance) == ("k 1 z", 3, 1)
    assert consensus(spark, [("a", "w " * 400 + "x"), ("a", "w " * 400)])["a"][1] == 2
