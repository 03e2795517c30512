"""Groups of records that are linked directly or through others.

Vertices are hashed into blocks and each edge lies in the grid cell of its two blocks, so that even the edges of a
vertex with a third of all links are spread over a row and a column of cells. Every round
  1. runs union-find on the edges of each cell, of a crowded one in parts, and keeps one edge per vertex to its least
     partner there;
  2. exchanges representatives: a vertex has at most one per (part of a) cell of its row and column, the least becomes its
     parent and the others are linked to it;
  3. replaces parents by their own parents,
until no parent changes. Nothing is gathered per vertex beyond its row and column, or on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.session import Workspace

#: Edges that one grid cell has on average; cells of more than CROWDED times as many are split.
CELL_EDGES = 1 << 16
CROWDED = 4
#: Crowded cells that are broadcast; more are joined by key.
MAX_BROADCAST = 100_000


def _least_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges of one cell: vertices and the least vertex each one is linked to."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(ids))
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return ids, ids[parent]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _cell(f: pd.DataFrame) -> pd.DataFrame:
    ids, roots = _least_roots(f["u"].to_numpy(np.int64), f["v"].to_numpy(np.int64))
    moved = ids != roots
    return pd.DataFrame({"v": ids[moved], "r": roots[moved]})


def _parted(cells: DataFrame, n_edges: int, cell_edges: int, work: Workspace) -> DataFrame:
    """``cells`` with ``part``: the edges of a crowded cell, such as those of a hub, are dealt out by hash."""
    if n_edges <= CROWDED * cell_edges:  # then no cell is crowded
        return cells.withColumn("part", F.lit(0))
    parts = F.ceil(F.col("n") / cell_edges).cast("int").alias("parts")
    crowded = cells.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED * cell_edges).select("row", "col", parts)
    crowded = work.write(crowded, "crowded")
    n = crowded.count()
    if not n:
        return cells.withColumn("part", F.lit(0))
    found = cells.join(F.broadcast(crowded) if n <= MAX_BROADCAST else crowded, ["row", "col"], "left")
    return found.withColumn("part", F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def connected_components(edges: DataFrame, src: str, dst: str, cell_edges: int = CELL_EDGES, max_rounds: int = 100) -> DataFrame:
    """``vertex, component`` of every vertex with an edge to another one; ``component`` is the least vertex linked to it.

    ``src`` and ``dst`` hold integers. Null ends, loops, repeated and turned-round edges count for nothing. An
    empty table gives an empty result. Raises if the parents aren't stable after ``max_rounds``; a chain of n
    edges takes about log2(n) rounds.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "components")
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    e = work.write(edges.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        n_edges = e.count()
        g = max(1, math.ceil(math.sqrt(n_edges / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(g)).cast("int")  # noqa: B023, E731
        cells = e.withColumn("row", block("u")).withColumn("col", block("v"))
        local = _parted(cells, n_edges, cell_edges, work).groupBy("row", "col", "part").applyInPandas(_cell, "v long, r long")
        # At most one representative per part of a cell of the vertex's row and column.
        exchanged = local.groupBy("v").agg(F.array_sort(F.collect_set("r")).alias("rs"))
        exchanged = work.write(exchanged, "exchanged")
        parent = exchanged.select("v", F.element_at("rs", 1).alias("p"))
        links = exchanged.select(F.element_at("rs", 1).alias("p"), F.explode(F.expr("slice(rs, 2, size(rs))")).alias("v")).select("v", "p")
        pairs = parent.unionByName(links)
        above = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = pairs.join(above, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        nxt = work.write(jumped.groupBy(F.col("p").alias("u"), "v").agg(F.max("moved").alias("moved")).where("u <> v"), "parents")
        open_ = exchanged.where("size(rs) > 1").limit(1).count() + nxt.where("moved").limit(1).count()
        work.drop(e)
        work.drop(exchanged)
        e = nxt.select("u", "v")
        if not open_:
            break
    else:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    members = e.select(F.col("v").alias("vertex"), F.col("u").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("vertex"), "component").distinct())


def link_groups(records: DataFrame, record_id: str, place: str, links: DataFrame, place_a: str, place_b: str) -> DataFrame:
    """``group_id, <record_id>`` of every record in a group of two or more.

    A link joins all records at its two places. It joins nothing if an end is null, both are the same place or an
    end names no record. Records at one place without a link are in no group. ``group_id`` is the least id of the group.
    """
    work = Workspace(records.sparkSession, "link-groups")
    a, b = F.col(place_a), F.col(place_b)
    pairs = work.write(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    named = pairs.select(F.col("a").alias("place")).union(pairs.select("b")).distinct()
    at = work.write(records.select(F.col(place).alias("place"), F.col(record_id).alias("id")).join(named, "place", "left_semi"), "records")
    least = work.write(at.groupBy("place").agg(F.min("id").alias("v")), "places")
    ends = pairs.join(least.select(F.col("place").alias("a"), F.col("v").alias("u")), "a").join(least.select(F.col("place").alias("b"), "v"), "b")
    groups = connected_components(ends, "u", "v")
    of_place = least.join(groups, least["v"] == groups["vertex"]).select("place", F.col("component").alias("group_id"))
    return at.join(of_place, "place").select("group_id", F.col("id").alias(record_id))
