"""Deduplication of new batches against all history through a persisted key index.

A record has up to three signatures: of its content hash and of its place (128 hashed bits each), and its perceptual
hash (256 bits). The index keeps three tables in a folder: content and place signatures bucketed by their first half,
band keys of the perceptual hashes bucketed by key, and the perceptual hashes themselves bucketed by record. It can be
opened again by path and version, in another session too.

A batch's keys are shuffled once, when they are written to their buckets. It is then matched bucket by bucket with
everything that came before it, candidates are verified on the signatures, and the batch becomes part of the index
when a manifest that names it is written. A small batch reads only the buckets that its keys fall into; as buckets
are split when the index grows, what it reads depends on its own size. Batches that wait are taken together in lots
as large as the index, so history is read about log2 of its growth times, however many batches there are.

Content and place have one band that must agree whole. The perceptual hash is cut into ``distance + 1`` bands: two
hashes that differ in at most ``distance`` bits agree in one of them, so that no match is lost (sampled minwise
bands would lose some). A band that many signatures share is split by a second band over the remaining bits,
which is exact for the same reason.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.session import Workspace

#: Most bits in which two perceptual hashes of a match differ.
DISTANCE = 6
#: Signatures under one band key from which a second band splits it, however large the index is.
HOT = 1024
#: Most band keys to split that are broadcast; more are joined by key.
MAX_BROADCAST = 100_000
#: Band keys per bucket beyond which the index is written anew with more buckets.
BUCKET_KEYS = 1 << 20
#: Versions after which the index is written anew as one.
MAX_VERSIONS = 32
#: Signatures or keys of a batch up to which only the buckets they fall into are read.
FEW = 256

_WORDS = ["w0", "w1", "w2", "w3"]
_FORMAT = 1
_TABLES = {
    "exact": ("w0", "w0 long, w1 long, kind int, seq long, first long"),
    "keys": ("key", "key long, band byte, seq long, first long"),
    "hashes": ("first", "first long, seq long, w0 long, w1 long, w2 long, w3 long"),
}


def _part(lo: int, hi: int) -> list[Column]:
    """Bits lo to hi - 1 of the four words, as one masked word for each word they touch."""
    out = []
    for w in range(4):
        a, b = max(lo, 64 * w), min(hi, 64 * w + 64)
        if a < b:
            mask = ((1 << (b - a)) - 1) << (a - 64 * w)
            out.append(F.col(f"w{w}").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")))
    return out


def _cuts(n: int) -> list[int]:
    return [round(256 * i / n) for i in range(n + 1)]


def band_keys(distance: int = DISTANCE) -> Column:
    """``key, band`` of one perceptual hash (``w0..w3``) for every band."""
    c = _cuts(distance + 1)
    return F.array(*[F.struct(F.xxhash64(F.lit(i), *_part(c[i], c[i + 1])).alias("key"), F.lit(i).cast("byte").alias("band")) for i in range(distance + 1)])


def sub_keys(distance: int = DISTANCE) -> Column:
    """Second keys within ``band``: each takes one cell of every other band, so they part the remaining bits."""
    n = distance + 1
    c = _cuts(n * n)
    cell = lambda i, j: _part(c[i * n + j], c[i * n + j + 1])
    by_band = [F.array(*[F.xxhash64(F.lit(j), *[x for k in range(n) if k != i for x in cell(k, j)]) for j in range(n)]) for i in range(n)]
    return F.element_at(F.array(*by_band), F.col("band") + 1)


def signatures(df: DataFrame, row_id: str, batch: str, content: Column, place: Column, phash: Column) -> DataFrame:
    """``row_id, batch, kind, w0..w3``: one row per signature that a record has.

    A null content or place has none, nor has a perceptual hash that is null, of another length than four words,
    holds a null or is all zero.
    """
    none, h = F.lit(None).cast("long"), F.col("phash")
    hashed = lambda k, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), *[(F.xxhash64(F.lit(10 * k + i), c) if i < 2 else none).alias(f"w{i}") for i in range(4)]))
    usable = (F.size(h) == 4) & ~F.exists(h, lambda w: w.isNull()) & F.exists(h, lambda w: w != 0)
    bits = F.when(usable, F.struct(F.lit(2).alias("kind"), *[F.element_at(h, i + 1).alias(f"w{i}") for i in range(4)]))
    every = F.filter(F.array(hashed(0, "content"), hashed(1, "place"), bits), lambda s: s.isNotNull())
    keyed = df.select(F.col(row_id).alias("row_id"), F.col(batch).alias("batch"), content.alias("content"), place.alias("place"), phash.alias("phash"))
    return keyed.select("row_id", "batch", F.explode(every).alias("s")).select("row_id", "batch", "s.*")


class _Files:
    """Small text files in the folder of an index, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Writes a file that must not exist; a reader sees all of it or nothing."""
        temporary = self._path(f".{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        final = self._path(name)
        self.fs.mkdirs(final.getParent())
        if self.fs.exists(final) or not self.fs.rename(temporary, final):
            self.fs.delete(temporary, False)
            raise RuntimeError(f"{name} exists already: another writer has appended to this index")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class HistoryIndex:
    """The persisted keys and signatures of all batches accepted so far, in ``root``.

    Entries are distinct signatures ``seq, kind, w0..w3, first``: ``seq`` numbers the batches in their order and
    ``first`` is the least record id of the batch that has the signature. A record id stands for one perceptual hash.

    ``version`` opens an older state for reading. Parameters are kept with the index; opening it with another ``distance``
    raises. One writer at a time: of two that append to one version the second one to finish raises and changes nothing.
    A version that was begun and not finished is never read, and its files are replaced by the next one.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, distance: int = DISTANCE, hot: int = HOT, bucket_keys: int = BUCKET_KEYS, max_versions: int = MAX_VERSIONS):
        self.spark, self.root, self.distance, self.hot, self.bucket_keys, self.max_versions = spark, root.rstrip("/"), distance, hot, bucket_keys, max_versions
        self.work = Workspace(spark, "history-work")
        self._files = _Files(spark, self.root)
        self._names: dict[str, str] = {}
        known = [int(n.split(".")[0]) for n in self._files.names("versions")]
        self._newest = max(known, default=0)
        self._read_only = version is not None and version != self._newest
        if version is not None and version not in known:
            raise ValueError(f"{root} has no version {version}")
        if not known:
            self.state = {"format": _FORMAT, "distance": distance, "version": 0, "generation": 0, "buckets": 0, "parts": [], "seq": -1, "n_keys": 0, "n_exact": 0, "counted": 0, "hot": None}
        else:
            self.state = json.loads(self._files.read(f"versions/{version or self._newest:08d}.json"))
            if (self.state["format"], self.state["distance"]) != (_FORMAT, distance):
                raise ValueError(f"{root} was written with format {self.state['format']} and distance {self.state['distance']}")
            self._mount()

    # --- tables ---------------------------------------------------------------------------------------------------

    def _location(self, table: str) -> str:
        return f"{self.root}/g{self.state['generation']:04d}/{table}"

    def _mount(self) -> None:
        """Tables of this session over the files of the generation; only finished versions are added."""
        self._unmount()
        for t, (by, columns) in _TABLES.items():
            name = f"history_{uuid.uuid4().hex}_{t}"
            location = self._location(t).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.state['buckets']} BUCKETS LOCATION '{location}'")
            self._names[t] = name
            for p in self.state["parts"]:
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (part={p})")

    def _unmount(self) -> None:
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = {}

    def _table(self, t: str) -> DataFrame:
        return self.spark.table(self._names[t])

    def _put(self, rows: DataFrame, t: str, part: int) -> None:
        by, columns = _TABLES[t]
        names = [c.split()[0] for c in columns.split(", ")]
        # An unfinished version may have left files of this number.
        self._files.delete(f"g{self.state['generation']:04d}/{t}/part={part}")
        ready = rows.repartition(self.state["buckets"], by).select(*names, F.lit(part).alias("part"))
        ready.write.insertInto(self._names[t])
        self.spark.sql(f"ALTER TABLE {self._names[t]} ADD IF NOT EXISTS PARTITION (part={part})")

    def _banded(self, hashes: DataFrame) -> DataFrame:
        return hashes.withColumn("b", F.explode(band_keys(self.distance))).select("b.*", "seq", "first")

    def _write(self, entries: DataFrame, part: int) -> tuple[int, int]:
        """Puts the entries into their buckets; their numbers of band keys and of exact signatures."""
        own = entries.where("kind = 2")
        self._put(entries.where("kind < 2"), "exact", part)
        self._put(own, "hashes", part)
        self._put(self._banded(own), "keys", part)
        return tuple(self._table(t).where(F.col("part") == part).count() for t in ("keys", "exact"))

    # --- hot keys -------------------------------------------------------------------------------------------------

    def _count_hot(self, state: dict, part: int) -> None:
        """Notes the keys that ``hot`` signatures share: of all versions whenever the index has doubled, else also of the new one."""
        whole = state["n_keys"] >= 2 * state["counted"]
        keys = self._table("keys")
        counts = (keys if whole else keys.where(F.col("part") == part)).groupBy("key", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.hot).select("key", "band")
        old = self._hot_keys(state)
        if not whole and old is not None:
            counts = counts.union(old).distinct()
        if whole:
            state["counted"] = state["n_keys"]
        name = f"hot/{state['version']:08d}"
        self._files.delete(name)
        counts.write.parquet(f"{self.root}/{name}")
        n = self.spark.read.schema("key long, band byte").parquet(f"{self.root}/{name}").count()
        state["hot"] = {"path": name, "n": n} if n else None

    def _hot_keys(self, state: dict) -> DataFrame | None:
        hot = state["hot"]
        if not hot:
            return None
        keys = self.spark.read.schema("key long, band byte").parquet(f"{self.root}/{hot['path']}")
        return F.broadcast(keys) if hot["n"] <= MAX_BROADCAST else keys

    # --- appending ------------------------------------------------------------------------------------------------

    def match_and_append(self, entries: DataFrame) -> DataFrame:
        """Matches the entries of one or more new batches with all smaller ones and accepts them as a new version.

        ``seq`` of the entries is above that of every batch held. The result, written to the shared folder, is
        ``seq, kind, w0..w3, matched`` of the entries that match; ``matched`` is the least id among the records they match.
        """
        part, seq = self._begin(entries)
        found = self.work.write(self._matches(part), "found")
        self._commit(seq)
        return found

    def append(self, entries: DataFrame) -> int:
        """Accepts the entries of one or more new batches without matching them; the new version."""
        _, seq = self._begin(entries)
        return self._commit(seq)

    def _begin(self, entries: DataFrame) -> tuple[int, int]:
        if self._read_only:
            raise RuntimeError("an older version is open for reading only")
        span = entries.agg(F.min("seq"), F.max("seq"), F.count_if(F.col("kind") == 2)).first()
        if span[0] is not None and span[0] <= self.state["seq"]:
            raise ValueError(f"batch {span[0]} isn't after the last one, {self.state['seq']}")
        self._make_room((span[2] or 0) * (self.distance + 1))
        part = self._newest + 1
        new = dict(self.state, version=part, parts=[*self.state["parts"], part])
        keys, exact = self._write(entries, part)
        new["n_keys"], new["n_exact"] = self.state["n_keys"] + keys, self.state["n_exact"] + exact
        self._count_hot(new, part)
        self._new = new
        return part, span[1] if span[1] is not None else self.state["seq"]

    def _commit(self, seq: int) -> int:
        self._new["seq"] = seq
        self._files.write_new(f"versions/{self._new['version']:08d}.json", json.dumps(self._new))
        self.state, self._newest = self._new, self._new["version"]
        return self._newest

    def _make_room(self, n_keys: int) -> None:
        """Writes the index anew with more buckets if it outgrows them, or as one part if it has many."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = self.state["n_keys"] + n_keys
        fits = self.state["buckets"] * self.bucket_keys >= total and len(self.state["parts"]) < self.max_versions
        if self.state["buckets"] and fits:
            return
        buckets = max(least, self.state["buckets"])
        while buckets * self.bucket_keys < 2 * total:
            buckets *= 2
        old = {t: self._table(t).drop("part") for t in self._names}
        mounted, self._names = self._names, {}
        old_root = f"g{self.state['generation']:04d}"
        self.state = dict(self.state, generation=self.state["generation"] + 1, buckets=buckets, parts=[])
        self._files.delete(f"g{self.state['generation']:04d}")
        self._mount()
        if old:
            part = self._newest + 1
            for t, rows in old.items():
                self._put(rows, t, part)
            self.state = dict(self.state, parts=[part], version=part)
            self._files.write_new(f"versions/{part:08d}.json", json.dumps(self.state))
            self._newest = part
            for name in mounted.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            for v in self._files.names("versions"):  # versions of the old generation went with its files
                if int(v.split(".")[0]) < part:
                    self._files.delete(f"versions/{v}")
            self._files.delete(old_root)

    # --- probing --------------------------------------------------------------------------------------------------

    def probe(self, entries: DataFrame) -> DataFrame:
        """What ``match_and_append`` gives, without accepting the entries: matches with batches of smaller ``seq`` that are held."""
        if not self.state["parts"]:
            return entries.select("seq", "kind", *_WORDS, F.col("first").alias("matched")).limit(0)
        new = self.work.write(entries, "probe")
        hashes = new.where("kind = 2")
        return self._matched(self.state, new.where("kind < 2"), self.work.write(self._banded(hashes), "probe-keys"), hashes)

    def _matches(self, part: int) -> DataFrame:
        own = {t: self._table(t).where(F.col("part") == part).drop("part") for t in _TABLES}
        return self._matched(self._new, own["exact"], own["keys"], own["hashes"])

    def _few(self, t: str, keys: DataFrame) -> DataFrame:
        """The table, or only the buckets that ``keys`` fall into if there are few of those."""
        by = _TABLES[t][0]
        some = keys.select(by).limit(FEW + 1).collect()  # at most FEW + 1 rows, without a shuffle
        table = self._table(t).drop("part")
        return table.where(F.col(by).isin(sorted({r[0] for r in some}))) if len(some) <= FEW else table

    def _matched(self, state: dict, exact: DataFrame, keys: DataFrame, hashes: DataFrame) -> DataFrame:
        # One key is the only equality of each join, so that the buckets serve it; the rest is a residual condition.
        e = self._few("exact", exact).select(F.col("w0").alias("h0"), F.col("w1").alias("h1"), F.col("kind").alias("h_kind"), F.col("seq").alias("h_seq"), F.col("first").alias("matched"))
        agree = F.col("w1").bitwiseXOR(F.col("h1")).bitwiseOR(F.col("kind").bitwiseXOR(F.col("h_kind")).cast("long")) == 0
        same = exact.join(e, (F.col("w0") == F.col("h0")) & agree & (F.col("h_seq") < F.col("seq"))).groupBy("seq", "kind", "w0", "w1").agg(F.min("matched").alias("matched"))
        none = F.lit(None).cast("long")

        hot = self._hot_keys(state)
        held = self._few("keys", keys)
        cold = keys if hot is None else keys.join(hot, ["key", "band"], "left_anti")
        h = held.select(F.col("key").alias("h_key"), F.col("band").alias("h_band"), F.col("seq").alias("h_seq"), F.col("first").alias("h_first"))
        met = cold.join(h, (F.col("key") == F.col("h_key")) & (F.col("band").bitwiseXOR(F.col("h_band")).cast("int") == 0) & (F.col("h_seq") < F.col("seq"))).select("seq", "first", "h_first")
        if hot is not None:
            met = met.unionByName(self._meet_hot(hot, keys, hashes, held))
        candidates = self.work.write(met.distinct(), "candidates")
        mine = candidates.join(hashes.drop("seq"), "first")
        words = self._few("hashes", candidates.select(F.col("h_first").alias("first"))).select(F.col("first").alias("h_first"), *[F.col(w).alias(f"h_{w}") for w in _WORDS])
        differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"h_{w}"))) for w in _WORDS[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("h_w0"))))
        near = mine.join(words, "h_first").where(differing <= self.distance).groupBy("seq", *_WORDS).agg(F.min("h_first").alias("matched"))
        return same.select("seq", "kind", "w0", "w1", none.alias("w2"), none.alias("w3"), "matched").unionByName(near.select("seq", F.lit(2).alias("kind"), *_WORDS, "matched"))

    def _meet_hot(self, hot: DataFrame, keys: DataFrame, hashes: DataFrame, held: DataFrame) -> DataFrame:
        """Candidates under the keys that many signatures share, by second bands."""
        sub = F.explode(sub_keys(self.distance)).alias("sub")
        h = held.join(hot, ["key", "band"]).join(self._table("hashes").drop("part", "seq"), "first").select("key", "band", sub, F.col("seq").alias("h_seq"), F.col("first").alias("h_first"))
        n = keys.join(hot, ["key", "band"]).join(hashes.drop("seq"), "first").select("key", "band", sub, "seq", "first")
        return n.join(h, ["key", "band", "sub"]).where("h_seq < seq").select("seq", "first", "h_first")

    def verify(self) -> bool:
        """Whether the tables hold as many rows as the manifest says."""
        held = {t: self._table(t).count() if self._names else 0 for t in ("keys", "exact")}
        return held == {"keys": self.state["n_keys"], "exact": self.state["n_exact"]}

    def close(self) -> None:
        """Leaves the index. Its files stay, what probes have written to the shared folder does not."""
        self._unmount()
        self.work.close()

    def __enter__(self) -> HistoryIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def destroy(self) -> None:
        self._unmount()
        self._files.delete("")
        self.work.close()


def lots(sizes: Iterable[tuple[object, int]]) -> list[list]:
    """Consecutive batches in lots, each closed once it is as large as all before it together."""
    out, own, held, size = [], [], 0, 0
    for b, n in sizes:
        own.append(b)
        size += n
        if size >= held:
            out.append(own)
            held, own, size = held + size, [], 0
    return [*out, own] if own else out


def matches_in_batches(signed: DataFrame, root: str | None = None, distance: int = DISTANCE, hot: int = HOT, **options: int) -> DataFrame:
    """Every record that matches one of a smaller batch, with the least id among those: ``first_id, row_id``.

    ``signed`` is what ``signatures`` gives; record ids are unique. Batches are taken in rising order, those that
    wait together in lots as large as the index: each is reduced to its distinct signatures, put into the buckets,
    matched with all smaller batches and accepted. Records with a null batch take no part. Records within a batch
    don't match each other. An empty table or a single batch gives an empty result. Copies of one file are one entry
    per batch, however many they are. With ``root`` the index stays there, and a next call continues it: batches
    then follow all that are held.
    """
    spark = signed.sparkSession
    work = Workspace(spark, "batches")
    index = HistoryIndex(spark, root or f"{work.root}/index", distance=distance, hot=hot, **options)
    try:
        rows = work.write(signed.where("batch is not null"), "signatures")
        sizes = [tuple(r) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()]  # one row per batch
        start, found = index.state["seq"] + 1, []
        if sizes:
            order = F.broadcast(spark.createDataFrame([(b, start + k) for k, (b, _) in enumerate(sizes)], rows.select("batch").schema.add("seq", "long")))  # one row per batch
            rows = rows.join(order, "batch").drop("batch")
            entries = work.write(rows.groupBy("seq", "kind", *_WORDS).agg(F.min("row_id").cast("long").alias("first")), "entries")
            number = {b: start + k for k, (b, _) in enumerate(sizes)}
            for lot in lots(sizes):
                own = entries.where(F.col("seq").between(number[lot[0]], number[lot[-1]]))
                if start == 0 and lot[-1] == sizes[0][0]:
                    index.append(own)  # there is nothing before the first batch
                else:
                    found.append(index.match_and_append(own))
        if not found:
            return signed.select(F.col("row_id").alias("first_id"), "row_id").limit(0)
        every = reduce(DataFrame.unionByName, found)
        same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(every[c]) for c in ["seq", "kind", *_WORDS]])
        result = rows.join(every, same).groupBy("row_id").agg(F.min("matched").alias("first_id")).select("first_id", "row_id")
        return Workspace(spark, "matches").write(result, "result")
    finally:
        index.close() if root else index.destroy()
        work.close()
