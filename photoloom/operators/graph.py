"""Connected components of moderate link tables, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.session import Workspace


def least_label_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``vertex, component`` of every vertex with an edge; ``component`` is the least vertex linked to it.

    Each round hooks every vertex to the least label among its neighbours and then to that label's own label, so
    a chain of n edges takes about log(n) rounds. Labels are written per round; only a count reaches the driver.
    """
    work = Workspace(edges.sparkSession, "labels")
    u, v = F.col(src), F.col(dst)
    both = edges.where(u != v).select(u.alias("u"), v.alias("v"))
    both = work.write(both.union(both.select("v", "u")).distinct(), "edges")
    label = work.write(both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(max_rounds):
        seen = both.join(label.withColumnRenamed("vertex", "v"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("component").alias("near"))
        # A label that hears of a smaller one through any of its members takes it over as well.
        mine = label.join(seen, "vertex").withColumn("best", F.least("component", "near"))
        heard = mine.groupBy(F.col("component").alias("root")).agg(F.min("best").alias("taken"))
        moved = mine.join(heard, mine["component"] == heard["root"]).select("vertex", F.col("component").alias("old"), F.least("best", "taken").alias("component"))
        up = moved.select(F.col("vertex").alias("r"), F.col("component").alias("above"))
        jumped = moved.join(up, moved["component"] == up["r"], "left").select("vertex", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        new = work.write(jumped, "labels")
        if not new.where("old <> component").limit(1).count():
            return new.select("vertex", "component")
        label = new.select("vertex", "component")
    raise RuntimeError(f"labels aren't stable after {max_rounds} rounds")
