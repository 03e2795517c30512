import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from photoloom.operators.search import top_k
from photoloom.sources import files, images, sinks
from photoloom.streaming.scans import in_batches, windowed_counts


def make(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(n[-5:].encode())


def test_scan(spark, tmp_path):
    make(tmp_path, "a/1.JPG", "a/.2.jpg", "b/Preview/3.jpg", "b/4.txt", "b/5.arw", "c/6.jpg")
    excluded = spark.createDataFrame([("c/6.jpg",)], "relpath string")
    got = files.scan_images(spark, f"file:{tmp_path}", excluded=excluded)
    assert sorted(r["relpath"] for r in got.collect()) == ["a/1.JPG", "b/5.arw"]
    hashed = files.with_sha256(files.scan_images(spark, f"file:{tmp_path}", skip_ignored=False, content=True).drop("mtime"))
    assert hashed.where("sha256 is not null").count() == 4  # Spark lists no hidden file


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\" c", ["x", "y"], {"k": 1.5}), (None, [], {})], "path string, flags array<string>, ev map<string,double>")
    sinks.write_csv(df, str(tmp_path / "t"), one_file=True)
    rows = {r["path"]: r for r in files.read_csv(spark, str(tmp_path / "t")).collect()}
    assert rows['a, "b" c']["flags"] == "x, y" and json.loads(rows['a, "b" c']["ev"]) == {"k": 1.5}
    (tmp_path / "g.csv").write_text('path,correct_category,notes\n"a,b.jpg",Landscape,%       \n')
    gold = files.read_csv(spark, str(tmp_path / "g.csv"), files.GOLD).first()
    assert (gold["path"], gold["notes"]) == ("a,b.jpg", "%       ")
    with pytest.raises(ValueError, match="missing columns: x"):
        files.require(df, "path", "x")
    assert files.with_defaults(df, path="p", year="Unknown").columns == ["path", "flags", "ev", "year"]
    assert files.present(df, "ev", "nope", "path").columns == ["ev", "path"]


def test_lists_rules_and_terms(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\n\n a prompt \n# x\nb\n")
    assert files.read_list(str(tmp_path / "p.txt")) == ["a prompt", "b"]
    assert files.read_list(str(tmp_path / "none"), ["f"]) == ["f"]
    assert files.search_terms("Dog, cat,,dog", str(tmp_path / "p.txt")) == ["Dog", "cat", "a prompt", "b"]
    assert files.search_terms("", None, ["x", "X"]) == ["x"]
    (tmp_path / "r.json").write_text('{"k": {"a": 1}}')
    assert files.read_rules(str(tmp_path / "r.json"), {"k": {"a": 0, "b": 2}}) == {"k": {"a": 1, "b": 2}}
    (tmp_path / "r.json").write_text("{")
    assert files.read_rules(str(tmp_path / "r.json"), {"k": 1}) == {"k": 1}
    (tmp_path / "e.txt").write_text("a\\b.jpg\n\n c.jpg \n")
    assert sorted(r["relpath"] for r in files.read_excludes(spark, str(tmp_path / "e.txt")).collect()) == ["a/b.jpg", "c.jpg"]


def test_years(spark, tmp_path):
    for y, header in (("2020", "path,theme_name"), ("2021", "path,theme_name,model"), ("2022", "path"), ("notes", "path")):
        (tmp_path / y).mkdir()
        (tmp_path / y / f"{y}_images.csv").write_text(header + "\n" + ",".join("x" for _ in header.split(",")) + "\n")
        if y != "2022":
            (tmp_path / y / f"{y}_themes.csv").write_text("cluster_id\n")
    assert files.year_folders(str(tmp_path)) == ["2020", "2021", "2022"]
    got = files.read_years(spark, str(tmp_path))
    assert sorted((r["year"], r["model"]) for r in got.collect()) == [("2020", None), ("2021", "x")]
    with pytest.raises(FileNotFoundError):
        files.read_years(spark, str(tmp_path), strict=True)
    assert files.read_years(spark, str(tmp_path), years=["1999"]) is None


def test_clean_source_and_times(spark):
    df = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, " "), (4, "b.txt"), (5, "c.png")], "pos int, path string")
    assert [r["pos"] for r in files.clean_source(df, "pos").orderBy("pos").collect()] == [1, 5]
    assert [r["pos"] for r in files.clean_source(df, "pos", limit=2).collect()] == [1]
    t = spark.createDataFrame([("bad", "2020:01:02 03:04:05", "2000-01-01 00:00:00"), (None, "", "2000-01-01 00:00:00")], "a string, b string, m string").withColumn("mtime", F.to_timestamp("m"))
    assert [str(r[0]) for r in t.select(files.capture_time("a", "b")).collect()] == ["2020-01-02 03:04:05", "2000-01-01 00:00:00"]


def test_vector_cache(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "m.npy", x)
    manifest = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "row_index long, path string")
    got = files.read_vectors(spark, str(tmp_path / "m.npy"), manifest)
    assert [r["embedding"] for r in got.orderBy("row_index").collect()] == x.tolist()
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "m.npy"), manifest.limit(2))
    sinks.write_vectors(got, str(tmp_path / "cache"), "k1")
    sinks.write_vectors(got.limit(1), str(tmp_path / "cache"), "k2")
    assert sinks.read_cached(spark, str(tmp_path / "cache"), "k1").count() == 6
    assert sinks.read_cached(spark, str(tmp_path / "cache"), "k3") is None and sinks.read_cached(spark, str(tmp_path / "none"), "k1") is None
    got.limit(1).withColumn("cache_key", F.lit("k1")).write.mode("append").partitionBy("cache_key").parquet(str(tmp_path / "cache/vectors"))
    assert sinks.read_cached(spark, str(tmp_path / "cache"), "k1") is None  # rows that no note counts
    np.save(tmp_path / "t.npy", np.asfortranarray(x))
    with pytest.raises(ValueError, match="columns"):
        files.read_vectors(spark, str(tmp_path / "t.npy"), manifest)


def test_embedding_plug_in(spark):
    def decoder():
        return lambda b: None if b == b"bad" else np.frombuffer(b * 200, np.uint8)[:192].reshape(8, 8, 3)

    df = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"bad")), ("c", bytearray(b"xyz"))], "path string, content binary")
    got = {r["path"]: r for r in images.embed(df, decoder, lambda: lambda pixels: np.array([[p.mean(), 1.0] for p in pixels])).collect()}
    assert got["b"]["embedding"] is None and got["b"]["phash"] is None and got["b"]["width"] == 0
    assert abs(sum(v * v for v in got["a"]["embedding"]) - 1) < 1e-5 and len(got["a"]["phash"]) == 4


def test_dead_letters_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "path string, v int")
    assert sinks.dead_letters(df, "v", str(tmp_path / "failed")).count() == 1
    assert [r[0] for r in spark.read.text(str(tmp_path / "failed")).collect()] == ["b"]
    sinks.write_summary(df.agg(F.count("v").alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["n"] == 1


def test_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q int, w array<double>")
    assert [tuple(r) for r in top_k(v, "id", "v", q, "q", "w", 2).orderBy("rank").collect()] == [(9, 1, 1, 1.0), (9, 2, 2, 1.0)]
    assert top_k(v, "id", "v", q, "q", "w", 9, min_score=0.5).count() == 2
    many = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)], "q int, w array<double>")
    lots = [sorted(tuple(r) for r in top_k(v, "id", "v", many, "q", "w", 2, lot=n).collect()) for n in (2, 100)]
    assert lots[0] == lots[1] and len(lots[0]) == 14
    assert top_k(v, "id", "v", q.limit(0), "q", "w", 2).count() == top_k(v.limit(0), "id", "v", q, "q", "w", 2).count() == 0


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    seen = []
    in_batches(windowed_counts(stream, "ts", "event_type", "1 day"), lambda df, k: seen.append(df.agg(F.sum("n")).first()[0] or 0), str(tmp_path / "cp")).awaitTermination()
    in_batches(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert seen[-1] == spark.read.parquet(source).count() and sum(seen[:-1]) <= seen[-1]


def test_plain_scan_and_hashes_in_pieces(spark, tmp_path):
    make(tmp_path, "a/1.JPG", "b/metadata/3.jpg", "b/5.orf", "c/6.nef")
    rows = files.scan_plain(spark, f"file:{tmp_path}")
    assert sorted(r["relpath"] for r in rows.collect()) == ["a/1.JPG", "c/6.nef"]
    (tmp_path / "big.jpg").write_bytes(b"x" * (3 * files.PIECE + 5))
    (tmp_path / "same.jpg").write_bytes(b"x" * (3 * files.PIECE + 5))
    got = {r["relpath"]: r["sha256"] for r in files.with_sha256(files.scan_images(spark, f"file:{tmp_path}")).collect()}
    assert got["big.jpg"] == got["same.jpg"] == hashlib.sha256(b"x" * (3 * files.PIECE + 5)).hexdigest()
    gone = spark.createDataFrame([(f"{tmp_path}/no.jpg", 1), (f"{tmp_path}/no2.jpg", 1)], "path string, size long")
    assert [r["sha256"] for r in files.with_sha256(gone).collect()] == [None, None]


def test_only_existing_files(spark, tmp_path):
    make(tmp_path, "1.jpg", "2.txt")
    df = spark.createDataFrame([(1, f"{tmp_path}/1.jpg"), (2, f"{tmp_path}/2.txt"), (3, f"{tmp_path}/3.jpg"), (4, None)], "pos int, path string")
    assert [r["pos"] for r in files.clean_source(df, "pos", existing=True).collect()] == [1]
    with pytest.raises(ValueError, match="no image"):
        files.clean_source(df.where("pos > 1"), "pos", existing=True)


def test_default_lists(spark, tmp_path):
    assert len(files.theme_prompts(str(tmp_path / "none"))) == 27 and len(files.theme_prompts(str(tmp_path / "none"), long=True)) == 51
    assert len(files.search_terms()) == 15


def exif(order, tags):
    pack = lambda kind, *x: struct.pack(order + kind, *x)
    body, at = b"", 8 + 2 + 12 * len(tags) + 4
    entries = b""
    for tag, text in tags.items():
        raw = text.encode() + b"\0"
        entries += pack("HHII", tag, 2, len(raw), at + len(body))
        body += raw
    block = (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + pack("H", len(tags)) + entries + pack("I", 0) + body
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + block


def test_exif_times_and_raw_previews(spark):
    good = exif("<", {0x0132: "2021:01:01 00:00:00", 0x9003: "2020:05:06 07:08:09"})
    assert images.exif_times(good) == ["2020:05:06 07:08:09", None, "2021:01:01 00:00:00"]
    assert images.exif_times(exif(">", {0x9004: "no time"})) == [None, "no time", None]
    assert images.exif_times(b"") == images.exif_times(None) == images.exif_times(good[:30]) == [None] * 3
    rows = [("a.jpg", bytearray(good)), ("b.nef", bytearray(good)), ("c.jpg", bytearray(b"none"))]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("mtime", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    got = {r["path"]: str(r["taken"]) for r in images.with_exif(df).collect()}
    assert got == {"a.jpg": "2020-05-06 07:08:09", "b.nef": "2000-01-01 00:00:00", "c.jpg": "2000-01-01 00:00:00"}
    jpeg = lambda n: b"\xff\xd8\xff" + b"p" * n + b"\xff\xd9"
    nested = b"\xff\xd8\xff" + jpeg(4) + b"q" * 50 + b"\xff\xd9"
    assert images.raw_preview(b"raw" + jpeg(9) + b"--" + nested + jpeg(3)) == nested and images.raw_preview(b"raw") is None
    decode = images.raw_decoder(lambda: lambda b: np.zeros((1, 1, 3)) if b == nested else None)
    assert decode(b"raw" + nested + b"tail").shape == (1, 1, 3) and decode(b"raw") is None


def test_pages_columns_and_copies(spark, tmp_path):
    rows = spark.createDataFrame([("B", 2, "x <1>", "b.jpg"), ("A", 1, 'say "hi"', "a'.jpg"), ("B", 1, None, None)], "section string, card int, text string, image string")
    sinks.write_page(rows, str(tmp_path / "page"), "T & T", "section", "card", ["text"], "image")
    lines = [x for f in sorted((tmp_path / "page").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0].endswith("<title>T &amp; T</title>") and [x for x in lines if x.startswith("<h2>")] == ["<h2>A</h2>", "<h2>B</h2>"]
    assert lines[2] == '<div class="card"><img loading="lazy" src="a&#x27;.jpg"><p>say &quot;hi&quot;</p></div>' and lines[5].endswith("<p>x &lt;1&gt;</p></div>")
    assert sinks.insert_first(rows, q=F.lit(1), text=F.lit("t")).columns == ["q", "text", "section", "card", "image"]
    make(tmp_path, "in/1.jpg")
    wanted = spark.createDataFrame([(f"{tmp_path}/in/1.jpg", f"{tmp_path}/out/k/1.jpg"), (f"{tmp_path}/in/2.jpg", f"{tmp_path}/out/k/2.jpg")], "a string, b string")
    assert [r["copied"] for r in sinks.copy_files(wanted, "a", "b").orderBy("source").collect()] == [True, False]
    assert (tmp_path / "out/k/1.jpg").read_bytes() == (tmp_path / "in/1.jpg").read_bytes()
