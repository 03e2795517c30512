"""The best record of each group of duplicates, by a vote of weighted tokens per aligned column.

``best_fields`` treats a record as a sequence of typed tokens, one for each column of each field. A token can only be
aligned with tokens of its own column, so progressive alignment in any order gives the same columns and needs no
search. Every usable row votes for its tokens, the heaviest token of a column is the consensus, and each field is taken
from the existing row that is closest to the consensus in that field's columns. The weight of a vote is its trust: one
vote of higher trust outweighs any number of lower ones, equal ones add up. (These are sums of powers of a base larger
than any group; as they are compared by the highest power first, no number has to hold them.)

``consensus_text`` does the same for text fields, whose tokens have no type: the most frequent values of a group are
aligned one after the other to a growing profile, every value is aligned to that profile, tokens vote per column with
their number of rows, and the existing value closest to the consensus comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.session import Workspace


@dataclass(frozen=True)
class Field:
    """``usable`` says which rows may vote for and give the values of ``columns``.

    ``trust`` is the weight of a row's votes: integers of falling importance, a null the least. The smallest id is the
    last resort. Without ``trust`` each row has one vote.
    """

    name: str
    usable: Column
    trust: tuple[Column, ...]
    columns: tuple[str, ...]


def best_fields(df: DataFrame, group: Column, row_id: str, fields: list[Field], least: int = 2) -> DataFrame:
    """One row per group of ``least`` rows or more: ``group_key, group_id, n_rows`` and per field ``<name>_id`` and its values.

    ``group_id`` is the smallest id of the group. ``<name>_id`` is the row that gives the field, -1 with null values
    if none is usable. Rows with a null group key are in no group. Repeated ids count as rows. A null in ``usable``
    means not usable; a null value is a gap, which takes no part in the vote. Of equal votes the greatest token (as
    text) wins; of rows equally close to the consensus the one with most trust, then the smallest id.

    Rows of small groups are dropped first. Votes are combinable aggregates per token and then per column, and a
    row meets its group's consensus, one short row, by a join; so no task holds a group, whatever its size.
    """
    work = Workspace(df.sparkSession, "records")
    keyed = df.select(
        group.alias("key"), F.col(row_id).cast("long").alias("id"),
        *[F.coalesce(f.usable, F.lit(False)).alias(f"use{i}") for i, f in enumerate(fields)],
        *[F.array(*[t.cast("long") for t in f.trust], *[-F.col(row_id).cast("long")] * bool(f.trust)).alias(f"trust{i}") for i, f in enumerate(fields)],
        *[F.struct(*f.columns).alias(f"own{i}") for i, f in enumerate(fields)],
    ).where("key is not null")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")
    rows = work.write(keyed.join(several, "key", "left_semi"), "rows")

    tokens = [
        F.when(F.col(f"use{i}"), F.struct(F.lit(i).alias("field"), F.lit(k).alias("column"), F.col(f"own{i}.{c}").cast("string").alias("token"), F.col(f"trust{i}").alias("trust")))
        for i, f in enumerate(fields) for k, c in enumerate(f.columns)
    ]
    cast = rows.select("key", F.explode(F.array(*tokens)).alias("t")).select("key", "t.*").where("token is not null")
    votes = cast.groupBy("key", "field", "column", "token").agg(F.max("trust").alias("trust"), F.count(F.lit(1)).alias("n"))
    winners = votes.groupBy("key", "field", "column").agg(F.max(F.struct("trust", "n", "token")).alias("best"))
    at = F.concat_ws(".", "field", "column")
    consensus = winners.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.col("best.token").alias("token")))).alias("consensus"))

    aggregates, out = [F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("group_id")], [F.col("key").alias("group_key"), "group_id", "n_rows"]
    for i, f in enumerate(fields):
        far = [(~F.col(f"own{i}.{c}").cast("string").eqNullSafe(F.element_at("consensus", f"{i}.{k}"))).cast("int") for k, c in enumerate(f.columns)]
        near = F.struct((-sum(far[1:], far[0])).alias("near"), F.col(f"trust{i}").alias("trust"), (-F.col("id")).alias("last"), F.col(f"own{i}").alias("own"))
        aggregates.append(F.max(F.when(F.col(f"use{i}"), near)).alias(f"best{i}"))
        out.append(F.coalesce(-F.col(f"best{i}.last"), F.lit(-1).cast("long")).alias(f"{f.name}_id"))
        out += [F.col(f"best{i}.own.{c}").alias(c) for c in f.columns]
    return rows.join(consensus, "key", "left").groupBy("key").agg(*aggregates).select(*out)


#: Distinct values of a group that form its profile; further values are aligned to it and vote all the same.
PROFILE = 64

_Profile = list[dict[str, int]]


def _align(profile: _Profile, tokens: list[str], total: int) -> list[tuple[int, int, str]]:
    """Columns of ``tokens`` when aligned to a profile of ``total`` rows: (column from 1, place after it, token).

    Putting a token into a column costs the share of rows that have another one or none there, leaving a column out
    the share that has one, and a place of its own 1.
    """
    n, m = len(profile), len(tokens)
    held = [sum(c.values()) / total for c in profile]
    cost = [[float(j) for j in range(m + 1)]]
    for i in range(1, n + 1):
        c, above = profile[i - 1], cost[-1]
        row = [above[0] + held[i - 1]]
        for j in range(1, m + 1):
            row.append(min(above[j - 1] + 1 - c.get(tokens[j - 1], 0) / total, above[j] + held[i - 1], row[j - 1] + 1))
        cost.append(row)
    i, j, out = n, m, []
    while j:
        if i and cost[i][j] == cost[i - 1][j - 1] + 1 - profile[i - 1].get(tokens[j - 1], 0) / total:
            out.append((i, 0, tokens[j - 1]))
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + held[i - 1]:
            i -= 1
        else:
            out.append((i, 1, tokens[j - 1]))
            j -= 1
    out.reverse()
    placed, last, k = [], None, 0
    for i, inserted, token in out:
        k = k + 1 if inserted and last == i else inserted
        last = i if inserted else None
        placed.append((i, k, token))
    return placed


def _profile(values: list[tuple[list[str], int]]) -> _Profile:
    """Progressive alignment: each value in turn is aligned to the profile of those before it and then joins it."""
    columns: _Profile = []
    total = 0
    for tokens, n in values:
        grown: dict[tuple[int, int], dict[str, int]] = {(i + 1, 0): c for i, c in enumerate(columns)}
        for i, k, t in _align(columns, tokens, max(total, 1)):
            c = grown.setdefault((i, k), {})
            c[t] = c.get(t, 0) + n
        columns = [grown[at] for at in sorted(grown)]
        total += n
    return columns


_PROFILE_TYPE = pa.list_(pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        firsts = f.column("firsts").to_pylist()
        built = [_profile([(v["tokens"], v["n"]) for v in x]) for x in firsts]
        profile = pa.array([[[{"token": t, "n": n} for t, n in c.items()] for c in p] for p in built], _PROFILE_TYPE)
        total = pa.array([sum(v["n"] for v in x) for x in firsts], pa.int64())
        yield pa.RecordBatch.from_arrays([f.column("group_key"), profile, total, f.column("n_values")], names=["group_key", "profile", "total", "n_values"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        got = []
        for key, profile, total, tokens, n in zip(*(f.column(c).to_pylist() for c in ("group_key", "profile", "total", "tokens", "n")), strict=True):
            columns = [{x["token"]: x["n"] for x in c} for c in profile]
            at = {(i, k): x for i, k, x in _align(columns, tokens, total)}
            for i in range(1, len(columns) + 1):
                got.append((key, i, 0, at.pop((i, 0), None), n))  # a gap votes too
            got += [(key, i, k, x, n) for (i, k), x in at.items()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], kind) for c, kind in enumerate(kinds)], names=["group_key", "i", "k", "token", "n"])


def _distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        far = []
        for a, b in zip(f["consensus"], f["tokens"], strict=True):
            a, b = ([] if a is None else list(a)), list(b)
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                before, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
            far.append(row[-1])
        yield pd.DataFrame({"group_key": f["group_key"], "value": f["value"], "n": f["n"], "distance": far})


def consensus_text(df: DataFrame, group: Column, value: Column, token: str = r"[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})") -> DataFrame:
    """Per group the existing value closest to the token consensus: ``group_key, value, n_values, distance``.

    ``token`` is the pattern between tokens. A group's PROFILE most frequent values, then the smallest, are aligned
    progressively; their profile fixes the columns. Every distinct value is then aligned to the profile by itself and votes with
    its number of rows, so no task ever holds a whole group; votes are summed before and after one shuffle. The token
    with most votes wins its column; among equals the greatest token, a token before a gap where the profile has one,
    and the gap where it has none. A column won by a gap gives nothing. Of values
    equally close, the one with more rows, then the smaller, comes out. Null and blank values take no part; a
    group without others has no row. Long values cost the square of their number of tokens.
    """
    work = Workspace(df.sparkSession, "consensus")
    values = (
        df.select(group.alias("group_key"), value.alias("value")).where("group_key is not null and trim(value) <> ''")
        .groupBy("group_key", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("tokens", F.filter(F.split("value", token), lambda x: x != ""))
    )
    values = work.write(values, "values")
    n_values = values.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_values"))
    turn = F.row_number().over(Window.partitionBy("group_key").orderBy(F.desc("n"), "value"))
    first = values.withColumn("turn", turn).where(F.col("turn") <= PROFILE).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("turn", "tokens", "n"))).alias("firsts"))
    guides = work.write(n_values.join(first, "group_key").where("n_values > 1").mapInArrow(_profiles, "group_key string, profile array<array<struct<token:string,n:long>>>, total long, n_values long"), "profiles")
    several = values.join(guides, "group_key")
    votes = several.select("group_key", "profile", "total", "tokens", "n").mapInArrow(_votes, "group_key string, i int, k int, token string, n long")
    columns = votes.groupBy("group_key", "i", "k", "token").agg(F.sum("n").alias("n"))
    all_rows = values.groupBy("group_key").agg(F.sum("n").alias("all"))
    winners = (
        columns.groupBy("group_key", "i", "k")
        .agg(F.max(F.struct("n", F.col("token").isNotNull().alias("real"), "token")).alias("best"), F.sum("n").alias("voted"))
        .join(all_rows, "group_key")
        # rows that have nothing in an inserted column vote for the gap there
        .where("best.real and best.n > all - voted")
        .groupBy("group_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", F.col("best.token").alias("token")))), lambda x: x["token"]).alias("consensus"))
    )
    far = several.select("group_key", "value", "tokens", "n").join(winners, "group_key", "left").mapInPandas(_distances, "group_key string, value string, n long, distance long")
    chosen = far.groupBy("group_key").agg(F.min(F.struct("distance", (-F.col("n")).alias("less"), "value")).alias("best"), F.count(F.lit(1)).alias("n_values"))
    single = values.join(guides.select("group_key"), "group_key", "left_anti")
    return chosen.select("group_key", F.col("best.value").alias("value"), "n_values", F.col("best.distance").alias("distance")).unionByName(
        single.select("group_key", "value", F.lit(1).cast("long").alias("n_values"), F.lit(0).cast("long").alias("distance"))
    )
