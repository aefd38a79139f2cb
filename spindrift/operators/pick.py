"""Arg-max / arg-min per key as partial aggregates: each task sends one row per key it holds.

Buffers are structs, so Spark sorts a partition by key before it aggregates; no window is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, tiebreak: list[str], columns: list[str]) -> DataFrame:
    """Columns of the newest row per key; ties go to the largest tiebreak."""
    best = F.max_by(F.struct(*columns), F.struct(order, *tiebreak))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def first(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the first row per key in the given order."""
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")
