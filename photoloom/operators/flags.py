"""Declarative row rules: named reasons, first match and additive scores as single expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(conditions: Mapping[str, Column]) -> Column:
    """The names of the conditions that hold, in their order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))


def with_reasons(df: DataFrame, conditions: Mapping[str, Column], column: str = "reasons") -> DataFrame:
    """The rows for which at least one condition holds, with the names."""
    return df.withColumn(column, reasons(conditions)).where(F.size(column) > 0)


def first_match(rules: Iterable[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def additive_score(base: float, parts: Iterable[tuple[Column, float]], least: float, most: float) -> Column:
    """``base`` and the amounts of all conditions that hold, between ``least`` and ``most``."""
    total = F.lit(base)
    for condition, amount in parts:
        total = total + F.when(condition, amount).otherwise(0)
    return F.greatest(F.lit(least), F.least(F.lit(most), total))
