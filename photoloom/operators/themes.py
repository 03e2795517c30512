"""Themes of clustered vectors: centroids, prompt labels, representatives, names and average-linkage clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.functions.text import clean_prompt, display_name
from photoloom.functions.vectors import dot, mean_vector, unit
from photoloom.operators.search import top_k
from photoloom.session import Workspace

MISC = "miscellaneous mixed subjects"
#: Most rows of one group that average linkage takes: it holds 4 bytes for every pair.
MAX_LINKED = 20_000


def centroids(rows: DataFrame, cluster: str, vector: str, dim: int) -> DataFrame:
    """``cluster, n, centroid``: the mean vector at unit length."""
    means = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), mean_vector(vector, dim).alias("mean"))
    return means.select(cluster, "n", unit(F.col("mean")).alias("centroid"))


def merge_small(rows: DataFrame, cluster: str, least: int) -> DataFrame:
    """Rows with ``theme_cluster``: clusters of fewer than ``least`` rows become one, numbered after the greatest."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    misc = (sizes.agg(F.max(cluster)).first()[0] or 0) + 1
    merged = sizes.select(F.col(cluster).alias("__c"), F.when(F.col("__n") < least, F.lit(misc).cast(rows.schema[cluster].dataType)).otherwise(F.col(cluster)).alias("theme_cluster"))
    return rows.join(merged, rows[cluster].eqNullSafe(merged["__c"])).drop("__c")


def top_prompts(themes: DataFrame, cluster: str, prompts: DataFrame, prompt_id: str, vector: str, k: int = 3) -> DataFrame:
    """The ``k`` prompts most like each centroid, ties to the later prompt as in a reversed ascending sort."""
    flipped = prompts.withColumn("__minus", -F.col(prompt_id))
    # The centroids are the stated query set's counterpart: prompts are few and scored against them in blocks.
    found = top_k(flipped, "__minus", vector, themes, cluster, "centroid", k)
    return found.select(cluster, "rank", (-F.col("__minus")).alias(prompt_id), "score")


def representatives(rows: DataFrame, row_id: str, cluster: str, vector: str, themes: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` rows nearest to their centroid; in clusters of at most ``k`` rows, the rows by id."""
    scored = rows.join(themes, cluster).withColumn("score", F.bround(dot(F.col(vector), F.col("centroid")), 4))
    order = Window.partitionBy(cluster).orderBy(F.when(F.col("n") > k, F.col("score")).desc_nulls_last(), row_id)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(cluster, F.col("rank").cast("long").alias("rank"), row_id, "score")


def dominant(rows: DataFrame, group: list[str], value: Column, position: Column) -> DataFrame:
    """The most frequent value per group with its count; of equals the one that occurs first."""
    counts = rows.groupBy(*group, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*group).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "value")).alias("best")).select(*group, F.col("best.value").alias("value"), F.col("best.n").alias("n"))


def theme_table(rows: DataFrame, row_id: str, cluster: str, vector: str, folder: Column, prompts: DataFrame, prompt_id: str, prompt_vector: str, prompt_text: str, dim: int, least: int = 6) -> DataFrame:
    """One row per theme: size, names, three labels, folder and three representatives."""
    merged = merge_small(rows.withColumn("__folder", folder), cluster, least)
    themes = Workspace(rows.sparkSession, "themes").write(centroids(merged, "theme_cluster", vector, dim), "centroids")  # read by every part below
    labels = top_prompts(themes, "theme_cluster", prompts, prompt_id, prompt_vector).join(prompts.select(prompt_id, prompt_text), prompt_id)
    labels = labels.groupBy("theme_cluster").agg(*[F.max(F.when(F.col("rank") == i, F.col(prompt_text))).alias(f"top_label_{i}") for i in (1, 2, 3)])
    reps = representatives(merged, row_id, "theme_cluster", vector, themes)
    reps = reps.groupBy("theme_cluster").agg(*[F.max(F.when(F.col("rank") == i, F.col(row_id))).alias(f"representative_{i}") for i in (1, 2, 3)])
    folders = dominant(merged, ["theme_cluster"], F.col("__folder"), F.col(row_id)).select("theme_cluster", F.col("value").alias("dominant_folder"))
    all_ = themes.drop("centroid").join(labels, "theme_cluster").join(reps, "theme_cluster").join(folders, "theme_cluster")
    mixed = F.col("n") < least
    name = F.when(mixed, MISC).otherwise(clean_prompt(F.col("top_label_1")))
    shown = F.when(mixed, F.concat(F.lit(MISC + " • "), F.lpad(F.col("theme_cluster").cast("string"), 2, "0"))).otherwise(
        display_name(F.col("top_label_1"), F.col("top_label_2"), F.col("dominant_folder"), F.col("theme_cluster"))
    )
    return all_.select("theme_cluster", F.col("n").alias("image_count"), name.alias("theme_name"), shown.alias("display_theme_name"), *[f"top_label_{i}" for i in (1, 2, 3)], "dominant_folder", *[f"representative_{i}" for i in (1, 2, 3)])


def theme_rows(rows: DataFrame, cluster: str, themes: DataFrame, least: int = 6) -> DataFrame:
    """``rows`` with their theme's number, names and labels, as ``theme_table`` gives them. Themes are few; their size decides the join."""
    own = themes.select("theme_cluster", "theme_name", "display_theme_name", "top_label_1", "top_label_2", "top_label_3")
    return merge_small(rows, cluster, least).join(own, "theme_cluster", "left")


def _average_linkage(d: np.ndarray, limit: float) -> np.ndarray:
    """Group of each row: clusters at an average distance below ``limit`` are merged, by nearest-neighbour chains."""
    m = len(d)
    d = d.astype(np.float32)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(m), np.ones(m, bool), [], []
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
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        alive[b] = False
        size[a] += size[b]
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for h, a, b in sorted(merges):
        if h < limit:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(m)])


def cluster_average_linkage(rows: DataFrame, row_id: str, vector: str, group: list[str], limit: float = 0.22) -> DataFrame:
    """``group, row_id, cluster_id``: agglomerative clusters of unit vectors by cosine distance, within each group.

    ``cluster_id`` numbers a group's clusters by their least row id. The method needs all pairs of a group, so a
    group of more than MAX_LINKED rows is refused rather than cut; split it by a coarser key first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, row_id]) + ", cluster_id int"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MAX_LINKED:
            raise ValueError(f"{len(f)} rows in one group; average linkage takes at most {MAX_LINKED}")
        f = f.sort_values(row_id, kind="stable").reset_index(drop=True)
        x = np.stack(f[vector].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        roots = _average_linkage(1 - x @ x.T, limit)
        return f[[*group, row_id]].assign(cluster_id=np.unique(roots, return_inverse=True)[1].astype(np.int32))

    return rows.where(F.col(vector).isNotNull()).select(*group, row_id, vector).groupBy(*group).applyInPandas(run, schema)
