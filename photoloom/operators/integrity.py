"""Referential integrity over time: references whose target is not there.

References and parent keys go into one stream that is range-partitioned and sorted by key, time, kind and row,
so that even one key with a third of all rows is spread over many tasks. Each task merges its slice in one
linear pass that keeps the running end of validity of the current key. A key that crosses a slice border is
settled afterwards from one carry row per slice; those rows are as many as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.session import Workspace

_OUT = "slice int, rel int, key string, row_id long, at_us long, began boolean, pending boolean, carry long"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_NEVER, _ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Reference:
    """``child`` has ``key, at, row_id``; ``parent`` has ``key, begin, until, row_id`` (``until`` null: still valid)."""

    name: str
    child: DataFrame
    parent: DataFrame


def _cummax(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running maximum within runs; ``new`` marks where a run begins."""
    levels, rank = np.unique(values, return_inverse=True)
    base = (np.cumsum(new) - 1) * len(levels)
    return levels[np.maximum.accumulate(rank + base) - base]


def _changes(c: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first one does."""
    out = np.ones(len(c), bool)
    out[1:] = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    slice_ = TaskContext.get().partitionId()
    first = last = None
    until = _NEVER
    for f in batches:
        n = len(f)
        if not n:
            continue
        rel, key = f.column("rel"), f.column("key")
        timed = f.column("at_us").is_valid().to_numpy(zero_copy_only=False)
        at = f.column("at_us").fill_null(0).to_numpy()
        child = f.column("child").to_numpy(zero_copy_only=False)
        end = np.where(child, _NEVER, f.column("until_us").fill_null(_ALWAYS).to_numpy())
        ends = [(rel[i].as_py(), key[i].as_py()) for i in (0, n - 1)]
        if ends[0] == last:
            end[0] = max(end[0], until)
        if first is None:
            first = ends[0]
        run = _cummax(end, _changes(rel) | _changes(key))
        last, until = ends[1], int(run[-1])
        lost = np.flatnonzero(child & (~timed | (run <= at)))
        if len(lost):
            g = f.take(pa.array(lost))
            known = timed[lost]
            pending = known & pc.and_(pc.equal(g.column("rel"), first[0]), pc.equal(g.column("key"), first[1])).to_numpy(zero_copy_only=False)
            none = pa.nulls(len(lost), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lost), slice_, np.int32)), g.column("rel"), g.column("key"), g.column("row_id"), g.column("at_us"), pa.array(known & (run[lost] > _NEVER)), pa.array(pending), none], names=_COLUMNS
            )
    if last is not None:
        row = dict(zip(_COLUMNS, (slice_, *last, None, None, until > _NEVER, False, until), strict=True))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(_COLUMNS, kinds, strict=True)], names=_COLUMNS)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without zone, for every year that Spark knows."""
    t = at.cast("timestamp_ntz")
    second = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return second * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    """The time without zone that ``micros`` was taken of."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000).cast("decimal(38,6)")).cast("decimal(18,6)"))


def orphan_references(references: list[Reference]) -> DataFrame:
    """Rows of the children whose key has no parent valid at the row's own time.

    A parent is valid from ``begin`` on, up to but not at ``until``. Result: ``reference, key, row_id, at, began``;
    ``began`` tells that some parent of the key had begun by then, so that the target is deleted rather than
    missing or late. Rows with a null key refer to nothing and are no cases; a row with a null time finds no
    parent; a parent without ``begin`` is never valid. Times travel as microseconds, so any year that Spark knows, such
    as an end of validity in 9999, counts exactly. Repeated rows come out as often as they go in. Empty
    tables give an empty result. Other columns are not read.
    """
    both = []
    for i, r in enumerate(references):
        parent = r.parent.where("key is not null and begin is not null")
        child = r.child.where("key is not null")
        both += [
            parent.select(F.lit(i).alias("rel"), "key", micros(F.col("begin")).alias("at_us"), F.lit(False).alias("child"), micros(F.col("until")).alias("until_us"), F.col("row_id").cast("long").alias("row_id")),
            child.select(F.lit(i).alias("rel"), "key", micros(F.col("at")).alias("at_us"), F.lit(True).alias("child"), F.lit(None).cast("long").alias("until_us"), F.col("row_id").cast("long").alias("row_id")),
        ]
    order = ["rel", "key", "at_us", "child", "row_id"]
    work = Workspace(references[0].child.sparkSession, "orphans")
    # Written once, as the range partitioning reads its input twice and keys are costly to make.
    stream = work.write(reduce(DataFrame.unionByName, both), "stream")
    found = work.write(stream.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_merge, _OUT), "found")
    work.drop(stream)

    # What the slices before hand on to a key at a border: the row of the last such slice, running over all of them.
    by_key = Window.partitionBy("rel", "key").orderBy("slice")
    carry = found.where("carry is not null").select(
        "rel", "key", F.col("slice").alias("after"), F.lead("slice").over(by_key).alias("up_to"), F.max("carry").over(by_key).alias("carried"),
    )
    open_ = found.where("carry is null").drop("carry")
    at_border = (F.col("after") < F.col("slice")) & (F.col("up_to").isNull() | (F.col("slice") <= F.col("up_to"))) & F.col("pending")
    c = carry.select(F.col("rel").alias("c_rel"), F.col("key").alias("c_key"), "after", "up_to", "carried")
    settled = open_.join(F.broadcast(c), (F.col("c_rel") == F.col("rel")) & (F.col("c_key") == F.col("key")) & at_border, "left")
    names = F.element_at(F.array(*[F.lit(r.name) for r in references]), F.col("rel") + 1)
    return settled.where(F.col("carried").isNull() | (F.col("carried") <= F.col("at_us"))).select(
        names.alias("reference"), "key", "row_id", from_micros(F.col("at_us")).alias("at"), (F.col("began") | F.coalesce(F.col("carried") > F.lit(int(_NEVER)), F.lit(False))).alias("began")
    )


def orphan_report(references: list[Reference]) -> DataFrame:
    """Orphan references per reference, month of the row's own time and reason: ``deleted``, ``late`` or ``missing``.

    ``late`` means that a parent of the key begins after the row's time only, ``missing`` that the key has none.
    """
    spark = references[0].child.sparkSession
    orphans = Workspace(spark, "orphan-report").write(orphan_references(references), "orphans")
    reports = []
    for r in references:
        own = orphans.where(F.col("reference") == r.name)
        later = own.where("not began").select("key").distinct().join(r.parent.where("key is not null and begin is not null").select("key"), "key", "left_semi")
        reports.append(own.join(later.withColumn("comes", F.lit(True)), "key", "left"))
    reason = F.when(F.col("began"), "deleted").when(F.col("comes"), "late").otherwise("missing")
    return (
        reduce(DataFrame.unionByName, reports)
        .groupBy(F.col("reference").alias("table_name"), F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
