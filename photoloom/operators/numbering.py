"""Row numbers over a whole table, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.session import Workspace


def numbered(df: DataFrame, order: list[str], column: str, start: int = 1) -> DataFrame:
    """``df`` with ``column``: numbers without gaps in ``order``, which is unique.

    Rows are range-partitioned and sorted; a row's number is its place in its slice and the rows of the slices before. Only
    one count per slice reaches the driver.
    """
    work = Workspace(df.sparkSession, "numbered")
    place = F.monotonically_increasing_id()
    ranged = work.write(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("__slice"), place.bitwiseAND((1 << 33) - 1).alias("__place")), "ranged")
    before, at = {}, start
    for r in ranged.groupBy("__slice").count().orderBy("__slice").collect():
        before[r["__slice"]] = at
        at += r["count"]
    if not before:
        return df.withColumn(column, F.lit(None).cast("long"))
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return ranged.select(*df.columns, (F.element_at(offsets, F.col("__slice")) + F.col("__place")).cast("long").alias(column))
