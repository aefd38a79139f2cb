"""Ordinal codes, threshold bins and code/label lookups as CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.sources import parameters as P


def ordinal(value: Column, vocabulary: Sequence[str]) -> Column:
    """Position of ``value`` in an ordered vocabulary; NULL when it is not listed."""
    return decode(value, {label: code for code, label in enumerate(vocabulary)})


def decode(value: Column, labels: Mapping, default=None) -> Column:
    """CASE lookup with an optional default for anything not listed."""
    branches = list(labels.items())
    first_key, first_label = branches[0]
    case = reduce(
        lambda acc, kv: acc.when(value == F.lit(kv[0]), F.lit(kv[1])),
        branches[1:],
        F.when(value == F.lit(first_key), F.lit(first_label)),
    )
    return case if default is None else case.otherwise(F.lit(default))


def gender_code(value: Column) -> Column:
    return F.when(value == "M", 1).otherwise(0)


def bins(value: Column, edges: Sequence[tuple[float, str]], last: str, closed_right: bool) -> Column:
    """First bin whose edge is not passed. A NULL value stays NULL."""
    case = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        inside = value <= F.lit(edge) if closed_right else value < F.lit(edge)
        case = case.when(inside, F.lit(label))
    return case.otherwise(F.lit(last))


def bet_category(avg_bet: Column) -> Column:
    return bins(avg_bet, P.BET_EDGES, P.BET_LAST, closed_right=True)


def win_rate_category(win_rate_pct: Column) -> Column:
    return bins(win_rate_pct, P.WIN_RATE_EDGES, P.WIN_RATE_LAST, closed_right=False)
