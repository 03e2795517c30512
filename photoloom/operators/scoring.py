"""Culling scores from vector pairs: each signal is the share of a positive against a negative prompt."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoloom.functions.vectors import clamp01, pair_softmax

#: Prompt pairs (positive, negative) per mode, and the weights of the mode that has any. Fixed values.
MODES: dict[str, dict[str, tuple[int, int]]] = {
    "stock": {"commercial_appeal": (0, 5), "copyspace_cleanliness": (1, 6), "broad_usability": (2, 6), "technical_quality": (3, 9), "release_friendliness": (4, 7)},
    "art": {"artistic_strength": (0, 3), "print_appeal": (1, 4), "distinctiveness": (2, 5)},
    "animal": {"subject_strength": (0, 3), "detail_closeness": (1, 3), "clean_isolation": (2, 4)},
    "group": {"group_presence": (0, 2), "group_clarity": (1, 4)},
    "landscape": {"visual_impact": (0, 3), "print_quality": (1, 5), "clean_scenery": (2, 4)},
}
MODE_WEIGHTS = {"stock": {"commercial_appeal": 0.28, "copyspace_cleanliness": 0.20, "broad_usability": 0.17, "technical_quality": 0.23, "release_friendliness": 0.12}}
#: Weights of the twelve-signal score. Fixed values.
POSITIVE = {"commercial_usefulness": 0.23, "technical_quality": 0.24, "clean_background": 0.16, "copy_space": 0.11, "generic_stock_fit": 0.16, "concept_clarity": 0.10}
PENALTY = {"branding_penalty": 0.22, "release_risk_penalty": 0.15, "editorial_bias_penalty": 0.12, "snapshot_penalty": 0.13, "technical_penalty": 0.23, "clutter_penalty": 0.15}
#: Notes by signal: from (at least, note), else below (less than, note). Fixed values.
NOTES = [
    ("commercial_usefulness", 0.72, "strong commercial potential", 0.45, "weak commercial concept"),
    ("technical_quality", 0.72, "looks technically solid", 0.45, "possible technical weakness"),
    ("clean_background", 0.70, "clean composition", 0.42, "distracting background"),
    ("copy_space", 0.70, "usable copy space", 0.42, "limited copy space"),
    ("generic_stock_fit", 0.70, "broad stock usability", 0.42, "narrow or personal image"),
    ("branding_penalty", 0.60, "possible branding/text risk", None, None),
    ("release_risk_penalty", 0.60, "possible people/property release risk", None, None),
    ("editorial_bias_penalty", 0.60, "more editorial than commercial", None, None),
]


def prompt_scores(vector: Column, prompts: list[list[float]]) -> Column:
    """The dot products of a vector with a short stated list of prompts, by one matrix product per Arrow batch.

    Null for a null vector, one of another length or one that holds a null.
    """
    matrix = np.array(prompts, np.float64).T

    def product(batch: pd.Series) -> pd.Series:
        out = np.full(len(batch), None, object)
        rows = [k for k, x in enumerate(batch) if x is not None and len(x) == len(matrix) and not np.isnan(np.asarray(x, np.float64)).any()]
        if rows:
            found = np.stack([batch.iloc[k] for k in rows]).astype(np.float64) @ matrix
            for k, x in zip(rows, found, strict=True):
                out[k] = x
        return pd.Series(out)

    return F.pandas_udf(product, "array<double>")(vector)


def signals(rows: DataFrame, vector: str, prompts: list[list[float]], pairs: dict[str, tuple[int, int]]) -> DataFrame:
    """``rows`` with one column per pair of prompts."""
    scored = rows.withColumn("__scores", prompt_scores(F.col(vector), prompts))
    return scored.withColumns({name: pair_softmax(F.col("__scores")[a], F.col("__scores")[b]) for name, (a, b) in pairs.items()}).drop("__scores")


def weighted(weights: dict[str, float], prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, [F.col(prefix + c) * w for c, w in weights.items()])


def mode_score(mode: str, prefix: str = "") -> Column:
    """The weighted score of a mode, or the mean of its signals, whose columns begin with ``prefix``."""
    pairs = MODES[mode]
    return weighted(MODE_WEIGHTS[mode], prefix) if mode in MODE_WEIGHTS else reduce(lambda a, b: a + b, [F.col(prefix + c) for c in pairs]) / len(pairs)


def stock_score() -> Column:
    return clamp01(weighted(POSITIVE) * 0.78 + (1.0 - weighted(PENALTY)) * 0.22)


def stock_reason() -> Column:
    notes = []
    for c, high, good, low, bad in NOTES:
        note = F.when(F.col(c) >= high, good)
        notes.append(note.when(F.col(c) < low, bad) if bad else note)
    return F.coalesce(F.nullif(F.concat_ws("; ", *notes), F.lit("")), F.lit("mixed stock signals"))
