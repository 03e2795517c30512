"""Exact and near duplicate groups of photos, keepers, excludes and greedy selection.

Photos come as ``photo_id, relpath, size, width, height, taken, phash, content`` (see ``inventory``).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoloom.functions.keys import content_key
from photoloom.functions.text import base_name, stem_key, suffix
from photoloom.functions.vectors import hamming, hash_bands, second_bands
from photoloom.operators.graph import least_label_components
from photoloom.session import Workspace

#: File kinds by how far they are preferred, name parts of derived files and name starts of cameras. Fixed values.
RENDERED = (".jpg", ".jpeg")
OTHER_IMAGES = (".tif", ".tiff", ".png", ".webp", ".heic", ".heif", ".bmp")
RAW = (".dng", ".arw", ".cr2", ".nef", ".orf", ".rw2", ".raf")
DERIVED_PARTS = ("edited", "export", "copy", "duplicate", "small", "medium", "thumb", "preview", "instagram", "lightroom", "snapseed", "dxo")
CAMERA_STARTS = ("dsc", "img_", "p", "pxl_", "dji_")

SECONDS = 8
BITS = 6
#: Rows under one band of hashes from which second bands split it.
HOT = 1024
#: Open edges of a greedy selection that the driver settles in one pass instead of further rounds.
LAST_EDGES = 100_000


def inventory(photos: DataFrame) -> DataFrame:
    """The photos that exist, with the time taken (else the file's) and the content key."""
    return photos.where("deleted_at is null").select(
        "photo_id", "relpath", "size", "width", "height", F.coalesce("capture_time", "mtime").alias("taken"), F.when(F.size("phash") == 4, F.col("phash")).alias("phash"), content_key(F.col("sha256")).alias("content")
    )


def format_rank(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*RENDERED), 5).when(s.isin(*OTHER_IMAGES), 4).when(s.isin(*RAW), 2).otherwise(1)


def name_score(path: Column) -> Column:
    """One less for a derived file's name, one more for a camera's."""
    name = F.lower(base_name(path))
    derived, camera = F.lit(False), F.lit(False)
    for t in DERIVED_PARTS:
        derived = derived | F.contains(name, F.lit(t))
    for t in CAMERA_STARTS:
        camera = camera | F.startswith(name, F.lit(t))
    return F.when(camera, 1).otherwise(0) - F.when(derived, 1).otherwise(0)


def keeper_score() -> Column:
    """The order in which the greatest photo of a group is kept."""
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return F.struct(
        format_rank(F.col("relpath")).alias("format"), (zero("width") * zero("height")).alias("pixels"), zero("size").alias("size"), name_score(F.col("relpath")).alias("name"), F.col("relpath").alias("relpath"), F.col("photo_id").alias("photo_id")
    )


def exact_groups(photos: DataFrame) -> DataFrame:
    """``group_id, photo_id`` of photos with equal size and content; ``group_id`` is the least photo id.

    Sizes that occur once are dropped first, as they need no content hash.
    """
    sized = photos.where("size is not null").groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    candidates = photos.join(sized, "size", "left_semi").where("content is not null")
    groups = candidates.groupBy("size", "content").agg(F.min("photo_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return candidates.join(groups, ["size", "content"]).select("group_id", "photo_id")


def keepers(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """``group_id, keeper_id, n`` of each group."""
    return groups.join(photos, "photo_id").groupBy("group_id").agg(F.max(keeper_score()).alias("best"), F.count(F.lit(1)).alias("n")).select("group_id", F.col("best.photo_id").alias("keeper_id"), "n")


def excludes(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """``relpath`` of all photos that are not the keeper of one of their groups."""
    kept = keepers(groups, photos)
    members = groups.join(photos.select("photo_id", "relpath"), "photo_id").join(kept, "group_id")
    best = photos.select(F.col("photo_id").alias("keeper_id"), F.col("relpath").alias("kept_path"))
    return members.join(best, "keeper_id").where("relpath <> kept_path").select("relpath").distinct()


def _classes(photos: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct ``keys`` with its least photo id, so that copies are never paired with each other."""
    return photos.groupBy(*keys).agg(F.min("photo_id").alias("rep"))


def _met(banded: DataFrame, cells: list[str], order: str, hashes: DataFrame, bands: int, hot: int, work: Workspace) -> DataFrame:
    """``a_id, b_id`` of rows (``id, <order>, n, band`` and ``cells``) that meet under a band, the one of lower ``order`` first.

    Bands that ``hot`` rows or more share are split by second bands, which lose no pair. ``hashes`` has ``id, phash``; rows
    with a false ``large`` can't be in such a band.
    """
    key = [*cells, "band"]
    many = banded.where("large").groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= hot).select(*key)
    many = work.write(many, "hot-bands")

    def pairs(rows: DataFrame, key: list[str]) -> DataFrame:
        a = rows.select(*key, F.col("id").alias("a_id"), F.col(order).alias("a_order"))
        b = rows.select(*key, F.col("id").alias("b_id"), F.col(order).alias("b_order"))
        return a.join(b, key).where("a_order < b_order").select("a_id", "b_id")

    if not many.limit(1).count():
        return pairs(banded, key).distinct()
    split = banded.where("large").join(many, key, "left_semi").join(hashes, "id").withColumn("second", F.explode(second_bands(F.col("phash"), F.col("n"), bands)))
    return pairs(banded.join(many, key, "left_anti"), key).union(pairs(split, [*key, "n", "second"])).distinct()


def _pairs(classes: DataFrame, cell: str, cells: Column, bits: int, more: Column | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of classes that share one of ``cells`` and whose hashes differ in at most ``bits`` bits.

    Cells of one class are dropped before the hash bands multiply the rows; within a cell classes meet under a band. Only
    ids travel there, the hashes are joined to the pairs.
    """
    work = Workspace(classes.sparkSession, "pairs")
    classes = work.write(classes, "classes")
    celled = classes.withColumn(cell, F.explode(cells))
    shared = celled.groupBy(cell).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(cell, (F.col("rows") >= hot).alias("large"))
    banded = celled.join(shared, cell).select(cell, "large", F.col("rep").alias("id"), F.posexplode(hash_bands(F.col("phash"), bits + 1)).alias("n", "band"))
    hashes = classes.select(F.col("rep").alias("id"), "phash")
    met = _met(banded, [cell], "id", hashes, bits + 1, hot, work)
    a, b = classes.alias("a"), classes.alias("b")
    both = met.join(a, F.col("a_id") == F.col("a.rep")).join(b, F.col("b_id") == F.col("b.rep"))
    found = both.withColumn("distance", hamming(F.col("a.phash"), F.col("b.phash"))).where(F.col("distance") <= bits)
    return (found if more is None else found.where(more)).select("a_id", "b_id", "distance")


def near_pairs_in_time(photos: DataFrame, seconds: int = SECONDS, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """``a_id, b_id, distance`` of photos taken at most ``seconds`` apart whose hashes differ in at most ``bits`` bits.

    Pairs are between the least ids of photos with one hash and time. Every photo lies in the cells of its own and
    of the next time slot, so two photos that are near in time share one. They meet there under one of ``bits + 1``
    hash bands, so a slot full of photos with an unset clock isn't paired off.
    """
    classes = _classes(photos.where("phash is not null and taken is not null"), ["phash", "taken"])
    second = F.floor(F.expr("(unix_date(cast(taken as date)) * 86400L + hour(taken) * 3600 + minute(taken) * 60 + cast(second(taken) as bigint))") / seconds).cast("long")
    apart = (F.col("b.taken") - F.col("a.taken")).between(F.expr(f"-interval '{seconds}' second"), F.expr(f"interval '{seconds}' second"))
    return _pairs(classes, "cell", F.array(second, second + 1), bits, apart, hot)


def near_pairs_by_stem(photos: DataFrame, bits: int = BITS + 2, hot: int = HOT) -> DataFrame:
    """``a_id, b_id, distance`` of photos with one file stem whose hashes differ in at most ``bits`` bits."""
    classes = _classes(photos.where("phash is not null").withColumn("stem", stem_key(F.col("relpath"))), ["phash", "stem"])
    return _pairs(classes, "cell", F.array("stem"), bits, None, hot)


def near_groups(photos: DataFrame, seconds: int = SECONDS, bits: int = BITS) -> DataFrame:
    """``group_id, photo_id`` of photos linked by time or stem pairs, directly or through others."""
    work = Workspace(photos.sparkSession, "near")
    hashed = photos.where("phash is not null").select("photo_id", "relpath", "taken", "phash", stem_key(F.col("relpath")).alias("stem"))
    photos = work.write(hashed, "photos")
    links = near_pairs_in_time(photos, seconds, bits).select("a_id", "b_id").union(near_pairs_by_stem(photos, bits + 2).select("a_id", "b_id"))
    for keys in (["phash", "taken"], ["phash", "stem"]):  # copies hang on the least id of their class
        # 128 hashed bits stand for the class, as only ids travel here.
        rows = photos.where(" and ".join(f"{k} is not null" for k in keys)).select("photo_id", *[F.xxhash64(F.lit(i), *keys).alias(f"c{i}") for i in range(2)])
        least = rows.groupBy("c0", "c1").agg(F.min("photo_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        links = links.union(rows.join(least, ["c0", "c1"]).where("photo_id <> rep").select(F.col("rep").alias("a_id"), F.col("photo_id").alias("b_id")))
    parts = least_label_components(work.write(links.distinct(), "links"), "a_id", "b_id")
    return parts.select(F.col("component").alias("group_id"), F.col("vertex").alias("photo_id"))


def member_key(groups: DataFrame) -> DataFrame:
    """``group_id, members``: a digest of the group's set of photos, whatever its size, and its count."""
    h = [F.sum(F.xxhash64(F.lit(i), "photo_id").cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("photo_id").alias("lo"), F.max("photo_id").alias("hi"), *h)


def near_minus_exact(near: DataFrame, exact: DataFrame) -> DataFrame:
    """The near groups whose set of members is not just that of an exact group, each set once."""
    same = ["n", "lo", "hi", "s0", "s1"]
    left = member_key(near).dropDuplicates(same).join(member_key(exact).select(*same), same, "left_anti")
    return near.join(left.select("group_id"), "group_id", "left_semi")


def _dropped_by_pass(edges: list[tuple]) -> set:
    """The rows that a sequential pass drops, of edges from an earlier to a later row."""
    later, waits = defaultdict(list), Counter()
    for a, b in edges:
        later[a].append(b)
        waits[b] += 1
    ready, out = [a for a in later if not waits[a]], set()
    while ready:
        a = ready.pop()
        for b in later.get(a, ()):
            if a not in out:
                out.add(b)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return out


def greedy_unique(rows: DataFrame, row_id: str, order: str, phash: str, bits: int = 5, top_n: int | None = None, last_edges: int = LAST_EDGES, hot: int = HOT) -> DataFrame:
    """``row_id`` of the rows that a pass in ``order`` keeps: those with no kept row before them within ``bits`` bits.

    ``order`` is unique. Of equal hashes only the first can be kept. A row is kept once all earlier near rows are
    dropped, and dropped once one is kept; rounds go on until all are decided, which gives just the sequential
    result. Each round settles at least the first open row. A chain of rows settles two a round, so once at most
    ``last_edges`` edges are open the driver decides them in one pass. Rows without a hash are left out.
    """
    work = Workspace(rows.sparkSession, "greedy")
    firsts = rows.where(F.size(phash) == 4).groupBy(F.col(phash).alias("phash")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(row_id).alias("id"))).alias("f")).select("phash", "f.o", "f.id")
    firsts = work.write(firsts, "firsts")
    banded = firsts.select(F.lit(True).alias("large"), "id", "o", F.posexplode(hash_bands(F.col("phash"), bits + 1)).alias("n", "band"))
    met = _met(banded, [], "o", firsts.select("id", "phash"), bits + 1, hot, work)
    a, b = firsts.select(F.col("id").alias("a_id"), F.col("phash").alias("a_hash")), firsts.select(F.col("id").alias("b_id"), F.col("phash").alias("b_hash"))
    near = met.join(a, "a_id").join(b, "b_id").where(hamming(F.col("a_hash"), F.col("b_hash")) <= bits)
    edges = work.write(near.select(F.col("a_id").alias("early"), F.col("b_id").alias("late")), "edges")
    open_edges, dropped, parts = edges, None, 0
    kind = rows.schema[row_id].dataType.simpleString()
    while (n := open_edges.limit(last_edges + 1).count()) > last_edges:
        # Rows with no undecided or kept row before them are kept; all that they are near to are dropped.
        waiting = open_edges.select(F.col("late").alias("id")).distinct()
        kept = open_edges.select(F.col("early").alias("id")).distinct().join(waiting, "id", "left_anti")
        out = work.write(open_edges.join(kept.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "dropped")
        dropped, parts = out if dropped is None else dropped.union(out), parts + 1
        if parts % 50 == 0:
            dropped = work.write(dropped, "dropped")  # one table, so the plan stays short
        gone = out.union(kept)
        nxt = open_edges.join(gone.withColumnRenamed("id", "early"), "early", "left_anti").join(out.withColumnRenamed("id", "late"), "late", "left_anti")
        open_edges = work.write(nxt.select("early", "late"), "edges")
    if n or dropped is None:
        last = _dropped_by_pass([tuple(r) for r in open_edges.collect()])  # at most last_edges rows
        out = work.write(rows.sparkSession.createDataFrame([(x,) for x in last], f"id {kind}"), "dropped")
        dropped = out if dropped is None else dropped.union(out)
    kept = firsts.join(dropped, "id", "left_anti").select(F.col("id").alias(row_id), F.col("o").alias("position"))
    return kept.orderBy("position").limit(top_n) if top_n else kept


def dedupe_summary(photos: DataFrame, exact: DataFrame, near: DataFrame, excluded: DataFrame, seconds: int = SECONDS, bits: int = BITS) -> DataFrame:
    """One row of counts."""
    counts = {
        "photo_count": photos.agg(F.count(F.lit(1)).alias("n")),
        "exact_group_count": exact.agg(F.countDistinct("group_id").alias("n")),
        "near_group_count": near.agg(F.countDistinct("group_id").alias("n")),
        "excluded_count": excluded.agg(F.count(F.lit(1)).alias("n")),
    }
    rows = reduce(DataFrame.unionByName, [df.withColumn("what", F.lit(name)) for name, df in counts.items()])
    return rows.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in counts]).withColumns({"seconds_window": F.lit(seconds), "phash_threshold": F.lit(bits)})


def group_rows(groups: DataFrame, photos: DataFrame) -> DataFrame:
    """Group rows as they are written out, the keeper marked ``yes``."""
    best = keepers(groups, photos).select("group_id", "keeper_id")
    mark = F.when(F.col("photo_id") == F.col("keeper_id"), "yes").otherwise("no")
    return groups.join(best, "group_id").join(photos, "photo_id").select("group_id", mark.alias("keeper"), "photo_id", "relpath", "size", "width", "height", F.col("taken").alias("capture_time"))
