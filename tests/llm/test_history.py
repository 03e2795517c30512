import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from photoloom.llm.history import HistoryIndex, lots, matches_in_batches, signatures

SCHEMA = "id long, batch int, content string, place string, phash array<long>"


def words(bits):
    out = [(bits >> (64 * i)) & ((1 << 64) - 1) for i in range(4)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def flip(bits, rnd, n):
    for i in rnd.sample(range(256), n):
        bits ^= 1 << i
    return bits


def signed(spark, rows):
    return signatures(spark.createDataFrame(rows, SCHEMA), "id", "batch", F.col("content"), F.col("place"), F.col("phash"))


def brute(rows):
    num = lambda h: sum((w & ((1 << 64) - 1)) << (64 * i) for i, w in enumerate(h))
    usable = lambda h: h is not None and len(h) == 4 and None not in h and any(h)
    out = []
    for i, b, c, p, h in rows:
        hits = []
        for j, b2, c2, p2, h2 in rows:
            if b is not None and b2 is not None and b2 < b and ((c is not None and c == c2) or (p is not None and p == p2) or (usable(h) and usable(h2) and (num(h) ^ num(h2)).bit_count() <= 6)):
                hits.append(j)
        if hits:
            out.append((min(hits), i))
    return sorted(out)


def run(spark, rows, **more):
    return sorted((r["first_id"], r["row_id"]) for r in matches_in_batches(signed(spark, rows), **more).collect())


def archive(seed, n=220):
    rnd = random.Random(seed)
    seeds = [rnd.getrandbits(256) for _ in range(8)]
    rows = []
    for i in rnd.sample(range(10_000), n):
        h = rnd.choice([None, [], [1], [0, 0, 0, 0], [1, None, 2, 3], *[words(flip(rnd.choice(seeds), rnd, rnd.choice([0, 2, 3, 4, 6]))) for _ in range(5)], words(rnd.getrandbits(256))])
        rows.append((i, rnd.choice([0, 0, 1, 2, 5, None]), rnd.choice([None, None, f"c{rnd.randrange(60)}"]), rnd.choice([None, f"p{rnd.randrange(80)}"]), h))
    return rows


@pytest.mark.parametrize("hot", [1024, 2])
def test_against_brute_force(spark, hot):
    rows = archive(7)
    assert run(spark, rows, hot=hot) == brute(rows)


def test_exactly_six_bits_in_every_position(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(256)
    rows = [(0, 0, None, None, words(base))]
    rows += [(i, 1, None, None, words(flip(base, rnd, 6))) for i in range(1, 40)] + [(i, 1, None, None, words(flip(base, rnd, 7))) for i in range(40, 60)]
    assert run(spark, rows) == [(0, i) for i in range(1, 40)]


def test_hot_copies_and_edges(spark):
    h = words(5 << 100)
    rows = [(i, i % 2, "same", f"p{i}", h) for i in range(300)]
    assert run(spark, rows) == [(0, i) for i in range(1, 300, 2)]
    assert run(spark, []) == []
    assert run(spark, [(1, 0, "a", "b", h), (2, 0, "a", "b", h)]) == []
    assert run(spark, [(1, None, "a", "b", h), (2, 1, "a", "b", h)]) == []
    assert run(spark, [(1, 3, "a", None, None), (2, 7, None, "q", None), (3, 9, "a", "q", None)]) == [(1, 3)]


def entries(spark, rows, batch):
    own = signed(spark, [r for r in rows if r[1] == batch])
    return own.groupBy(F.lit(batch).cast("long").alias("seq"), "kind", "w0", "w1", "w2", "w3").agg(F.min("row_id").alias("first"))


def test_index_grows_batch_by_batch(spark, tmp_path):
    rows = archive(11, 120)
    with HistoryIndex(spark, f"file://{tmp_path}/index") as index:
        assert index.probe(entries(spark, rows, 1)).count() == 0
        index.append(entries(spark, rows, 0))
        one = index.probe(entries(spark, rows, 1)).count()
        assert one == index.probe(entries(spark, rows, 1)).count() > 0  # probing changes nothing
        assert index.match_and_append(entries(spark, rows, 1)).count() == one
        assert index.verify()
        with pytest.raises(ValueError, match="isn't after"):
            index.append(entries(spark, rows, 1))


def test_batch_is_matched_in_its_buckets(spark, tmp_path):
    """Both sides of the joins with history are read in their buckets, with no exchange in between."""
    rnd = random.Random(2)
    rows = [(i, i % 3, f"c{i % 400}", f"p{i}", words(rnd.getrandbits(256))) for i in range(900)]
    with HistoryIndex(spark, f"file://{tmp_path}/index") as index:
        index.append(entries(spark, rows, 0))
        part, _ = index._begin(entries(spark, rows, 1))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = index._matches(part)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = plan.splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        scans = [k for k, x in enumerate(lines) if index._names["exact"] in x]
        assert len(scans) == 2
        for k in scans:
            assert "Bucketed: true" in lines[k]
            while "Join" not in lines[k]:
                assert "Exchange" not in lines[k]
                k = max(i for i in range(k) if depth[i] < depth[k])


def test_reopened_in_another_session(spark, tmp_path):
    """An index is built by one Spark application and probed by another; unfinished versions are not seen."""
    rows, root = archive(11, 120), f"file://{tmp_path}/index"
    program = f"""
import sys
sys.path[:0] = {[p for p in sys.path if p]!r}
from photoloom.session import local_session
import test_history as t
spark = local_session(2, "1g", **{{"spark.checkpoint.dir": "file://{tmp_path}/other", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}})
with t.HistoryIndex(spark, {root!r}) as index:
    index.append(t.entries(spark, t.archive(11, 120), 0))
    index._begin(t.entries(spark, t.archive(11, 120), 2))  # never finished
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    with HistoryIndex(spark, root) as index:
        assert index.state["version"] == 1 and index.verify()
        got = {(r["kind"], r["w0"], r["matched"]) for r in index.probe(entries(spark, rows, 1)).collect()}
        with HistoryIndex(spark, f"file://{tmp_path}/fresh") as fresh:
            fresh.append(entries(spark, rows, 0))
            assert got == {(r["kind"], r["w0"], r["matched"]) for r in fresh.match_and_append(entries(spark, rows, 1)).collect()} != set()
        index.append(entries(spark, rows, 1))  # replaces what the other application left
        assert index.state["version"] == 2 and index.verify()
        with HistoryIndex(spark, root, version=1) as old:
            assert old.state["n_keys"] < index.state["n_keys"] and old.verify()
            with pytest.raises(RuntimeError, match="reading only"):
                old.append(entries(spark, rows, 2))
    with pytest.raises(ValueError, match="distance"):
        HistoryIndex(spark, root, distance=3)
    with pytest.raises(ValueError, match="no version"):
        HistoryIndex(spark, root, version=9)


def test_two_writers(spark, tmp_path):
    rows, root = archive(11, 60), f"file://{tmp_path}/index"
    with HistoryIndex(spark, root) as a, HistoryIndex(spark, root) as b:
        b._begin(entries(spark, rows, 0))
        a.append(entries(spark, rows, 0))
        with pytest.raises(RuntimeError, match="another writer"):
            b._commit(0)


def test_continued_index(spark, tmp_path):
    """Two calls over one index give what one call gives over all batches."""
    rows, root = archive(5), f"file://{tmp_path}/index"
    early, late = [r for r in rows if r[1] is not None and r[1] < 2], [r for r in rows if r[1] is not None and r[1] >= 2]
    got = run(spark, early, root=root) + run(spark, late, root=root, max_versions=2)  # written anew in between
    assert sorted(got) == brute(rows)


@pytest.mark.parametrize("n_batches", [12, 48])
def test_a_small_batch_reads_as_much_as_it_has_keys(spark, tmp_path, n_batches):
    """Rows read for a batch of three records stay under a bound of its own keys, whatever history holds."""
    rnd = random.Random(1)
    rows = [(i, 0 if i < 1500 else 1 + i % n_batches, None, f"p{i}", words(rnd.getrandbits(256))) for i in range(1500 + 40 * n_batches)]
    with HistoryIndex(spark, f"file://{tmp_path}/index", bucket_keys=100) as index:
        index.append(entries(spark, rows, 0))
        whole = spark.createDataFrame([r for r in rows if r[1]], SCHEMA)
        later = signatures(whole, "id", "batch", F.col("content"), F.col("place"), F.col("phash"))
        index.append(later.groupBy(F.col("batch").cast("long").alias("seq"), "kind", "w0", "w1", "w2", "w3").agg(F.min("row_id").alias("first")))
        new = [(10**6 + i, 99, None, f"p{i}", rows[i][4]) for i in range(3)]
        probed = index.probe(entries(spark, new, 99))
        assert probed.count() == 6
        few = index._few("keys", index._banded(entries(spark, new, 99).where("kind = 2")))._jdf.queryExecution()
        few.toRdd().count()
        read = few.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
        assert read <= 21 * 2 * 100 < index.state["n_keys"] / 3


def test_lots():
    assert lots([(0, 5), (1, 2), (2, 2), (3, 1), (4, 9), (5, 1)]) == [[0], [1, 2, 3], [4, 5]]
    assert lots([]) == [] and lots([(7, 0)]) == [[7]]
    many = lots([(i, 10) for i in range(1000)])
    assert len(many) <= 11 and [b for lot in many for b in lot] == list(range(1000))
