"""Compares queries with their SQL in DuckDB: row count, columns and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings photo_info photo_matches "
    "master_gallery_images gold_labels_v1 eval_items subject_areas subject_labels subset_requests"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    """A value as both engines show it."""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((plain(k), plain(v)) for k, v in sorted(x.items()))
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf)
    own = rows(df.columns, df.collect())
    cur = connect(sf).execute(sql)
    columns = [c[0] for c in cur.description]
    other = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if own != other:
        a, b = set(map(repr, own)) - set(map(repr, other)), set(map(repr, other)) - set(map(repr, own))
        return f"{name}: {len(own)} and {len(other)} rows; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""
