"""Top N rows of every group.

Per-group histograms of the order columns give every group of more than N rows a threshold bin that leaves at least
N rows; rows below it are filtered out, and the rest is ranked exactly. The thresholds of the largest groups, a
bounded number, are broadcast; if there are more groups than that, the others' thresholds are joined by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.session import Workspace

#: Histogram bins to a factor of e in the score.
BINS_PER_E = 64
#: Most thresholds that are broadcast, those of the largest groups.
MAX_BROADCAST = 100_000
#: Parts into which the rows of a group are ranked first where Spark itself sets no limit before the last ranking.
SALTS = 64
_LEAST = -(1 << 20)


def _usable(c: str) -> Column:
    """The score as a double, null for NaN."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _bin(c: str) -> Column:
    """A bin number that never falls when the score rises; null and NaN lie below all scores."""
    x = _usable(c)
    scaled = F.signum(x) * F.log1p(F.abs(x)) * BINS_PER_E
    bounded = F.greatest(F.lit(float(_LEAST // 2)), F.least(F.lit(float(-_LEAST // 2)), scaled))  # for infinite scores
    return F.coalesce(F.floor(F.when(x.isNotNull(), bounded)).cast("long"), F.lit(_LEAST).cast("long"))


#: Integers up to this size are bins of their own.
OWN_BIN = 1 << 15


def _joint_bin(df: DataFrame, scores: list[str]) -> Column:
    """A bin number that never falls along the order of ``scores``.

    A bin of the first score may be divided by bins of the second one only if it holds a single value: so are the bins
    of integers up to OWN_BIN, and of nulls.
    """
    first = scores[0]
    second = _bin(scores[1]) if len(scores) > 1 else F.lit(0).cast("long")
    shift = F.lit(1 << 21)
    x = _usable(first)
    alone = x.isNull()
    if df.schema[first].dataType.typeName() in ("byte", "short", "integer", "long"):
        beyond = F.signum(x) * (OWN_BIN + F.floor(F.log1p(F.abs(x) - OWN_BIN) * BINS_PER_E))
        small = F.abs(x) <= OWN_BIN
        own = F.when(x.isNull(), F.lit(_LEAST)).when(small, x).otherwise(beyond).cast("long")
        alone = alone | small
    else:
        own = _bin(first)
    return own * shift + F.when(alone, second).otherwise(F.lit(0).cast("long"))


def _thresholds(rows: DataFrame, keys: list[str], joint: Column, n: int, work: Workspace) -> tuple[DataFrame, int]:
    """``__<key>.., __least, __size`` of every group of more than ``n`` rows, and their number.

    ``__size`` is the binary logarithm of the group's number of rows, rounded down.
    """
    histogram = rows.groupBy(*keys, joint.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*keys)
    from_top = own.orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        histogram.withColumns({"__all": F.sum("__n").over(own), "__upto": F.sum("__n").over(from_top)})
        .where((F.col("__all") > n) & (F.col("__upto") >= n) & (F.col("__upto") - F.col("__n") < n))
        .select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bin").alias("__least"), F.floor(F.log2("__all")).cast("int").alias("__size"))
    )
    found = work.write(found, "thresholds")
    return found, found.count()


def _filtered(rows: DataFrame, keys: list[str], thresholds: DataFrame, send: bool) -> DataFrame:
    t = thresholds.drop("__size")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
    kept = rows.join(F.broadcast(t) if send else t, same, "left").where("__least is null or __bin >= __least")
    return kept.drop("__least", *[f"__{k}" for k in keys])


def top_n_per_group(df: DataFrame, keys: list[str], scores: list[str], tie: str, n: int, most_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``df`` that are among the first ``n`` of their group, with their ``rank`` (``rank_`` if that name is taken).

    Order: ``scores`` descending, null and NaN last and equal to each other, then ``tie`` ascending (a repeated
    tie value is ordered by nothing further, so it should be unique). A row with a null in any of ``keys`` is in no
    group. ``n`` below 1 gives no rows; a group of fewer than ``n`` rows comes out whole.

    Every group of more than ``n`` rows gets a threshold. At most ``most_broadcast`` of them are broadcast, those of
    the groups of 2**s rows or more for the least such s; all others meet their rows by a join on the group, so
    a row that is shuffled for it belongs to a group that isn't among the largest.
    """
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    joint = _joint_bin(df, scores)
    thresholds, total = _thresholds(rows, keys, joint, n, Workspace(df.sparkSession, "top-n"))
    survivors = rows.withColumn("__bin", joint)
    if total <= most_broadcast:
        survivors = _filtered(survivors, keys, thresholds, True)
    else:
        by_size = {r["__size"]: r["count"] for r in thresholds.groupBy("__size").count().collect()}  # at most 64 rows
        least, held = max(by_size) + 1, 0
        while held + by_size.get(least - 1, 0) <= most_broadcast:
            least -= 1
            held += by_size.get(least, 0)
        survivors = _filtered(survivors, keys, thresholds.where(F.col("__size") >= least), True)
        survivors = _filtered(survivors, keys, thresholds.where(F.col("__size") < least), False)
    order = [_usable(c).desc_nulls_last() for c in scores] + [F.col(tie).asc_nulls_last()]
    name = "rank"
    while name in df.columns:
        name += "_"

    def first_n(rows: DataFrame, *within: Column | str) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col(name) <= n)

    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        # Spark limits no task's rows before such a ranking, and all rows of a group may tie at its threshold.
        survivors = first_n(survivors, *keys, F.pmod(F.xxhash64(tie, *scores), F.lit(SALTS))).drop(name)
    return first_n(survivors, *keys).select(*df.columns, name)
