"""Incremental scans: counts per time window, and new files checked against the accepted ones as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and ``by`` of a stream; rows later than ``late`` are dropped with their window's state."""
    timed = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    counts = timed.groupBy(F.window("__at", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


def in_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``step`` on every micro-batch: the hook for probing and appending to a key index. Returns the query."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
