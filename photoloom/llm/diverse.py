"""A varied subset of given size, by a cluster-feature tree.

Rows are reduced to their distinct feature combinations. Every partition summarises its combinations in a
cluster-feature tree of bounded size; the summaries are merged in rounds into one, whose leaf entries are
agglomerated by Ward linkage. The dendrogram is cut at the size wanted, and each group is represented by the record
nearest to its centre. A combination counts once however many rows it has (``mass`` 0), so that large groups of
similar records don't draw the centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.session import Workspace

#: Leaf entries of a summary, and so of the Ward linkage; more only if a larger subset is wanted.
LEAF_ENTRIES = 4096
#: Largest subset that is cut from one linkage, which takes 4 bytes for every pair of 1.5 times as many entries. A larger
#: one is cut within groups, each of them by a tree and linkage of its own.
DIRECT = 4096
#: Entries of a tree node.
BRANCHING = 48
#: Combinations that are put into a tree, or compared with all centres, at once.
BLOCK = 1024
#: Summaries merged in one task.
FAN_IN = 8
#: Signs that stand for one categorical value: two values differ in about half of them.
SIGNS = 32


@dataclass
class _Node:
    leaf: bool
    n: np.ndarray
    ls: np.ndarray
    ss: np.ndarray
    child: list


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0.0)


class CFTree:
    """Cluster features (count, linear sum, square sum) in a height-balanced tree of at most ``most`` leaf entries."""

    def __init__(self, dim: int, most: int, threshold: float = 0.0):
        self.dim, self.most, self.t2 = dim, most, threshold**2
        self.entries = 0
        self.root = _Node(True, np.zeros(0), np.zeros((0, dim)), np.zeros(0), [])

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Puts a block of features into the tree."""
        nodes = self._insert(self.root, n, ls, ss)
        while len(nodes) > 1:
            nodes = self._split(self._above(nodes))
        self.root = nodes[0]
        while self.entries > self.most:
            self._rebuild()

    @staticmethod
    def _above(nodes: list[_Node]) -> _Node:
        return _Node(False, np.array([c.n.sum() for c in nodes]), np.array([c.ls.sum(0) for c in nodes]), np.array([c.ss.sum() for c in nodes]), nodes)

    def _insert(self, x: _Node, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> list[_Node]:
        """The nodes, one or more, that take the place of ``x``."""
        if x.leaf:
            self._absorb(x, n, ls, ss)
            return self._split(x)
        to = _squares(ls / n[:, None], x.ls / x.n[:, None]).argmin(1)
        nodes = []
        for k, c in enumerate(x.child):
            own = to == k
            nodes += self._insert(c, n[own], ls[own], ss[own]) if own.any() else [c]
        return self._split(self._above(nodes))

    def _joined(self, n: np.ndarray, norm: np.ndarray, ss: np.ndarray) -> np.ndarray:
        """Whether features of these sums, ``norm`` being the square of the linear sum, are within the threshold."""
        square = ss / n
        return square - norm / n**2 <= self.t2 + 1e-12 * (1 + square)

    def _absorb(self, x: _Node, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Adds each row to its nearest entry if that stays within the threshold, else as an entry."""
        open_ = np.arange(len(n))
        while len(open_):
            if len(x.n):
                k = _squares(ls[open_] / n[open_, None], x.ls / x.n[:, None]).argmin(1)
                fits = self._joined(x.n[k] + n[open_], ((x.ls[k] + ls[open_]) ** 2).sum(1), x.ss[k] + ss[open_])
                # One row per entry at a time, so that an entry never exceeds the threshold.
                at, first = np.unique(np.where(fits, k, -1), return_index=True)
                at, first = at[at >= 0], first[at >= 0]
                x.n[at] += n[open_[first]]
                x.ls[at] += ls[open_[first]]
                x.ss[at] += ss[open_[first]]
                new = open_[~fits]
                open_ = np.delete(open_, first)
            else:
                new = open_
            if len(new):
                own = (ls[new] ** 2).sum(1)
                close = self._joined(n[new, None] + n[new], own[:, None] + own + 2 * ls[new] @ ls[new].T, ss[new, None] + ss[new])
                leads = np.zeros(len(new), bool)
                for i in range(len(new)):
                    leads[i] = not (close[i] & leads).any()
                x.n, x.ls, x.ss = np.append(x.n, n[new[leads]]), np.concatenate([x.ls, ls[new[leads]]]), np.append(x.ss, ss[new[leads]])
                self.entries += int(leads.sum())
                open_ = np.setdiff1d(open_, new[leads])

    def _split(self, x: _Node) -> list[_Node]:
        if len(x.n) <= BRANCHING:
            return [x]
        d = _squares(c := x.ls / x.n[:, None], c)
        a, b = np.unravel_index(d.argmax(), d.shape)
        left = d[a] <= d[b]
        left[b] = False
        left[a] = True
        out = []
        for part in (left, ~left):
            out += self._split(_Node(x.leaf, x.n[part], x.ls[part], x.ss[part], [] if x.leaf else [c for c, p in zip(x.child, part, strict=True) if p]))
        return out

    def leaves(self) -> Iterator[_Node]:
        stack = [self.root]
        while stack:
            x = stack.pop()
            if x.leaf:
                yield x
            else:
                stack += reversed(x.child)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = list(self.leaves())
        return np.concatenate([l.n for l in x]), np.concatenate([l.ls for l in x]), np.concatenate([l.ss for l in x])  # noqa: E741

    def _rebuild(self) -> None:
        """Starts a tree with a wider threshold and puts the leaf entries into it."""
        near = []
        for x in self.leaves():
            if len(x.n) > 1:
                d = _squares(c := x.ls / x.n[:, None], c)
                np.fill_diagonal(d, np.inf)
                near.append(d.min(1))
        # A pair of equal counts merged at distance d has a radius of d / 2.
        least = float(np.median(np.concatenate(near))) / 4 if near else 0.0
        wider = CFTree(self.dim, 1 << 60, np.sqrt(max(least, self.t2 * 1.5, 1e-9)))
        n, ls, ss = self.features()
        for k in range(0, len(n), BLOCK):
            wider.add(n[k : k + BLOCK], ls[k : k + BLOCK], ss[k : k + BLOCK])
        self.root, self.entries, self.t2 = wider.root, wider.entries, wider.t2


def ward_merges(n: np.ndarray, centres: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges of Ward linkage in rising order of height, by nearest-neighbour chains; each names one entry of either side."""
    m = len(n)
    size = n.astype(np.float64).copy()
    d = np.empty((m, m), np.float32)
    for k in range(0, m, BLOCK):  # one matrix of 4 bytes a pair
        own = slice(k, k + BLOCK)
        d[own] = _squares(centres[own], centres) * (2 * size[own, None] * size / (size[own, None] + size))
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(m, bool), [], []
    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), a, b))
        # Lance-Williams for Ward, on squared distances
        s = size[a] + size[b] + size
        row = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / s
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        alive[b] = False
        size[a] += size[b]
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
    return sorted(merges)


def cut(merges: list[tuple[float, int, int]], m: int, k: int) -> np.ndarray:
    """Group number of each of ``m`` entries after all merges but the last ``k - 1``."""
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in merges[: max(0, m - k)]:
        parent[root(b)] = root(a)
    return np.unique([root(i) for i in range(m)], return_inverse=True)[1]


def _vectors(hashes: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """Signs of the hashes of categorical values, scaled so that two values of weight 1 lie about sqrt(2) apart."""
    bits = [((h.astype(np.int64)[:, None] >> np.arange(SIGNS)) & 1) * 2.0 - 1 for h in hashes]
    return np.concatenate([w / np.sqrt(SIGNS) * b for w, b in zip(weights, bits, strict=True)], axis=1)


def summarise(combinations: DataFrame, hashes: list[str], weights: list[float], mass: float, most: int, work: Workspace) -> DataFrame:
    """At most ``most`` cluster features (``n, ls, ss``) of all combinations."""
    shape = "part int, n double, ls array<double>, ss double"

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tree = None
        for f in frames:
            v = _vectors([f[h].to_numpy() for h in hashes], weights)
            tree = tree or CFTree(v.shape[1], most)
            n = f["rows"].to_numpy(np.float64) ** mass
            for k in range(0, len(n), BLOCK):
                own, x = n[k : k + BLOCK], v[k : k + BLOCK]
                tree.add(own, own[:, None] * x, own * (x**2).sum(1))
        if tree:
            a, b, c = tree.features()
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "n": a, "ls": list(b), "ss": c})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part", kind="stable")
        n, ls, ss = f["n"].to_numpy(), np.stack(f["ls"].to_numpy()), f["ss"].to_numpy()
        tree = CFTree(ls.shape[1], most)
        for k in range(0, len(n), BLOCK):
            tree.add(n[k : k + BLOCK], ls[k : k + BLOCK], ss[k : k + BLOCK])
        a, b, c = tree.features()
        return pd.DataFrame({"part": int(f["part"].iloc[0]) // FAN_IN, "n": a, "ls": list(b), "ss": c})

    parts = work.write(combinations.mapInPandas(first, shape), "summaries")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = work.write(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, shape), "summaries")
    return parts


class _Combinations:
    """Distinct feature combinations ``h0.., rows, id`` and what is done with them."""

    def __init__(self, table: DataFrame, hashes: list[str], weights: list[float], mass: float, leaf_entries: int, direct: int, work: Workspace):
        self.table, self.hashes, self.weights, self.mass, self.leaf_entries, self.direct, self.work = table, hashes, weights, mass, leaf_entries, direct, work
        self.kind = table.schema["id"].dataType.simpleString()

    def centres(self, sizes: list[int]) -> list[np.ndarray]:
        """Centres of the groups of each size, of one linkage; the groups of a smaller size hold those of a larger one whole."""
        most = max(self.leaf_entries, max(sizes) * 3 // 2)
        cf = summarise(self.table, self.hashes, self.weights, self.mass, most, self.work).orderBy("n", "ss", "ls").toPandas()  # ``most`` rows
        if cf.empty:
            return [np.zeros((0, 1)) for _ in sizes]
        n, ls = cf["n"].to_numpy(), np.stack(cf["ls"].to_numpy())
        merges = ward_merges(n, ls / n[:, None])
        out = []
        for k in sizes:
            g = cut(merges, len(n), k)
            out.append(np.stack([np.bincount(g, weights=ls[:, j]) for j in range(ls.shape[1])], 1) / np.bincount(g, weights=n)[:, None])
        return out

    def _nearest(self, centres: list[np.ndarray], best_only: bool) -> DataFrame:
        """``request, centre, far, id, rows``: every combination's nearest centre, or of each centre and block the nearest combination and all rows."""
        # Centres are as many as the rows wanted, at most ``direct`` a request.
        shipped = self.table.sparkSession.sparkContext.broadcast(centres)
        hashes, weights = self.hashes, self.weights

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for start in range(0, len(whole), BLOCK):
                    f = whole.iloc[start : start + BLOCK]
                    v = _vectors([f[h].to_numpy() for h in hashes], weights)
                    for r, c in enumerate(shipped.value):
                        d = _squares(v, c)
                        at = d.argmin(1)
                        out = pd.DataFrame({"request": r, "centre": at, "far": d[np.arange(len(v)), at].round(9), "id": f["id"].to_numpy(), "rows": f["rows"].to_numpy()})
                        if best_only:
                            sums = out.groupby("centre")["rows"].sum()
                            out = out.sort_values(["centre", "far", "id"], kind="stable").drop_duplicates("centre")
                            out["rows"] = out["centre"].map(sums)
                        yield out

        return self.table.mapInPandas(run, f"request int, centre int, far double, id {self.kind}, rows long")

    def pick(self, sizes: list[int]) -> DataFrame:
        """``request, id, group_rows`` of the combination nearest to each group centre; ``request`` counts the sizes from 0."""
        parts = []
        small = [r for r, k in enumerate(sizes) if k <= self.direct]
        if small:
            best = self._nearest(self.centres([sizes[r] for r in small]), True).groupBy("request", "centre").agg(F.min(F.struct("far", "id")).alias("best"), F.sum("rows").alias("group_rows"))
            number = F.element_at(F.array(*[F.lit(r) for r in small]), F.col("request") + 1)
            parts.append(best.select(number.alias("request"), F.col("best.id").alias("id"), "group_rows"))
        for r, k in enumerate(sizes):
            if k > self.direct:
                parts.append(self._pick_within(k).select(F.lit(r).alias("request"), "id", "group_rows"))
        return self.work.write(reduce(DataFrame.unionByName, parts), "picked")

    def _pick_within(self, k: int) -> DataFrame:
        """A subset too large for one linkage: shares of it are cut within the groups of a coarse cut, as large as the groups are."""
        top = self.centres([max(2, min(self.direct, -(-2 * k // self.direct)))])
        nearest = self.work.write(self._nearest(top, False).select("centre", "id").join(self.table, "id"), "within", ["centre"])
        sizes = [tuple(x) for x in nearest.groupBy("centre").count().orderBy("centre").collect()]  # one row per group
        total = sum(n for _, n in sizes)
        parts, given, seen = [], 0, 0
        for c, n in sizes:
            seen += n
            share = min(n, -(-k * seen // total) - given)
            given += share
            own = _Combinations(nearest.where(F.col("centre") == c).drop("centre"), self.hashes, self.weights, self.mass, self.leaf_entries, self.direct, self.work)
            if share == n:
                parts.append(own.table.select("id", F.col("rows").alias("group_rows")))
            elif share > 0 and len(sizes) > 1:
                parts.append(own.pick([share]).select("id", "group_rows"))
        return reduce(DataFrame.unionByName, parts) if parts else self.table.select("id", F.col("rows").alias("group_rows")).limit(0)

    def farthest(self, k: int, but: DataFrame, n: int) -> DataFrame:
        """``id`` of the ``n`` combinations that are farthest from their centres, without those of ``but``."""
        others = self.table.join(but.select("id"), "id", "left_anti")
        if k > self.direct:
            return others.orderBy("id").limit(n).select("id")
        return _Combinations(others, *self._settings())._nearest(self.centres([k]), False).orderBy(F.desc("far"), "id").limit(n).select("id")

    def _settings(self) -> tuple:
        return self.hashes, self.weights, self.mass, self.leaf_entries, self.direct, self.work


def varied_subset(df: DataFrame, row_id: str, features: dict[str, tuple[Column, float]], sizes: dict[int, int], mass: float = 0.0, leaf_entries: int = LEAF_ENTRIES, direct: int = DIRECT) -> DataFrame:
    """``request_id, subset_size, <row_id>, group_rows`` of a varied subset for each request.

    ``features`` names categorical columns with their weights; ``sizes`` gives the size for each request id. A
    null feature is a value of its own, another one for every combination of the other features, so that records don't
    look alike for what they lack. Every subset has exactly its size, or all rows if there are fewer; a row is
    taken once. Each group of the dendrogram, cut at the size wanted, is represented by the combination nearest to its
    centre, and among rows of one combination by the smallest id. ``group_rows`` is the number of rows
    nearest to the same centre, null for rows that only fill up: where there are fewer groups than wanted, the
    combinations farthest from their centres and then further rows of the combinations come in. Ids must be unique.
    A size below 1 gives no rows, an empty table none at all. A size above ``direct`` is shared out over the groups of a
    coarser cut by their number of combinations, and each share is cut within its group in the same way.
    """
    spark = df.sparkSession
    wanted = {int(r): int(k) for r, k in sizes.items() if k and k > 0}
    kind = df.schema[row_id].dataType.simpleString()
    out_schema = f"request_id int, subset_size int, `{row_id}` {kind}, group_rows long"
    if not wanted:
        return spark.createDataFrame([], out_schema)
    work = Workspace(spark, "varied")
    weights = [w for _, w in features.values()]
    hashes = [f"h{i}" for i in range(len(features))]
    own = [F.xxhash64(F.lit(i), c.isNull(), c) for i, (c, _) in enumerate(features.values())]
    apart = F.xxhash64(*own)
    rows = df.select(F.col(row_id).alias("id"), *[F.when(c.isNotNull(), o).otherwise(F.xxhash64(F.lit(i), apart)).alias(h) for i, (h, o, (c, _)) in enumerate(zip(hashes, own, features.values(), strict=True))])
    combinations = work.write(rows.groupBy(*hashes).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id")), "combinations")
    n = combinations.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    requests = list(wanted)
    c = _Combinations(combinations, hashes, weights, mass, leaf_entries, direct, work)
    few = [r for r in requests if wanted[r] < n]
    parts = []
    if few:
        picked = c.pick([wanted[r] for r in few])
        got = {few[x["request"]]: x["count"] for x in picked.groupBy("request").count().collect()}
        parts.append(picked.select(F.element_at(F.array(*[F.lit(r) for r in few]), F.col("request") + 1).alias("request_id"), "id", "group_rows"))
    none = F.lit(None).cast("long").alias("group_rows")
    for r in requests:
        if r in few:
            lacking = wanted[r] - got.get(r, 0)
            if lacking > 0:
                own = picked.where(F.col("request") == few.index(r))
                parts.append(work.write(c.farthest(wanted[r], own, lacking), "fill").select(F.lit(r).alias("request_id"), "id", none))
            continue
        parts.append(combinations.select(F.lit(r).alias("request_id"), "id", F.col("rows").alias("group_rows")))
        lacking = wanted[r] - n
        if lacking > 0:
            order = F.row_number().over(Window.partitionBy(*hashes).orderBy("id"))
            more = rows.join(combinations.select("id"), "id", "left_anti").withColumn("turn", order).where(F.col("turn") <= lacking)
            parts.append(more.orderBy("turn", "id").limit(lacking).select(F.lit(r).alias("request_id"), "id", none))
    size = F.element_at(F.create_map(*[F.lit(x) for p in wanted.items() for x in p]), F.col("request_id"))
    return reduce(DataFrame.unionByName, parts).select("request_id", size.cast("int").alias("subset_size"), F.col("id").alias(row_id), "group_rows")
