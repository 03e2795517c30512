"""Vector search: scores of all rows against a stated set of query vectors, best rows per query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the workers at once; more are searched for in several lots.
LOT = 10_000


def _lots(queries: DataFrame, query_id: str, vector: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    rows = queries.where(F.col(vector).isNotNull()).select(query_id, vector).orderBy(query_id).toLocalIterator()
    while lot := list(islice(rows, size)):
        yield [r[0] for r in lot], np.array([r[1] for r in lot], np.float64)


#: Scores that a task holds at once.
CELLS = 4_000_000


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` greatest scores of each column, of equal ones the first, as a stable sort gives them."""
    n = len(scores)
    if k >= n:
        return np.argsort(-scores, axis=0, kind="stable")
    least = np.partition(scores, n - k, axis=0)[n - k]
    # All rows above the k-th score and the first ones at it: sorted by score, then by row.
    best = np.empty((k, scores.shape[1]), np.int64)
    for c in range(scores.shape[1]):
        s = scores[:, c]
        above, at = np.flatnonzero(s > least[c]), np.flatnonzero(s == least[c])
        own = np.concatenate([above, at[: k - len(above)]])
        best[:, c] = own[np.lexsort((own, -s[own]))]
    return best


def top_k(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, min_score: float = 0.0, digits: int = 4, lot: int = LOT) -> DataFrame:
    """``<query_id>, rank, <row_id>, score``: the ``k`` rows of greatest dot product per query, ties by row id.

    A ``min_score`` above 0 drops lower scores first. Each Arrow batch is scored by one matrix product and hands on
    its own best ``k`` per query, so the shuffle holds at most ``k`` rows per query and batch. Scores are rounded to
    ``digits`` before ranking. Rows with a null vector or one of another length are left out.
    """
    row_type, query_type = rows.schema[row_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = f"`{query_id}` {query_type}, `{row_id}` {row_type}, score double"

    def scan(ids: list, q: np.ndarray) -> DataFrame:
        shipped = rows.sparkSession.sparkContext.broadcast((ids, q))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shipped.value
            for f in frames:
                f = f[[x is not None and len(x) == q.shape[1] for x in f[vector]]].sort_values(row_id, kind="stable")
                if not len(f):
                    continue
                own = f[row_id].to_numpy()
                x = np.stack(f[vector].to_numpy()).astype(np.float64)
                step = max(1, CELLS // len(x))
                for at in range(0, len(q), step):  # blocks of at most CELLS scores
                    scores = (x @ q[at : at + step].T).round(digits) + 0.0  # no negative zero
                    best = _first_k(scores, k)
                    some = np.array(ids[at : at + step], dtype=object)
                    found = pd.DataFrame({query_id: np.repeat(some, len(best)), row_id: own[best.T.ravel()], "score": np.take_along_axis(scores, best, 0).T.ravel()})
                    yield found[found["score"] >= min_score] if min_score > 0 else found

        return rows.select(row_id, vector).mapInPandas(run, out)

    parts = [scan(*x) for x in _lots(queries, query_id, query_vector, lot)]
    scored = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], out)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, F.col("rank").cast("long").alias("rank"), row_id, "score")


def result_counts(found: DataFrame, query_id: str) -> DataFrame:
    return found.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_found"))


def score_columns(found: DataFrame, row_id: str, query_id: str, names: dict[object, str]) -> DataFrame:
    """Long results with one more column per query that holds the score of that query's rows only."""
    return found.select("*", *[F.when(F.col(query_id) == q, F.col("score")).alias(f"score_{n}") for q, n in names.items()])


def score_map(found: DataFrame, query_id: str) -> DataFrame:
    """Long results with a map from each row's query to its score: ``score_columns`` for any number of queries."""
    return found.withColumn("scores", F.create_map(query_id, "score"))


def unscored(current: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``current`` without an equal manifest row in the cache: the only ones to embed again."""
    return current.join(cached.select(*keys).distinct(), keys, "left_anti")
