"""Forward rolling windows over days, including exact distinct counts.

A distinct count over a rolling window is not a sum of daily distinct counts, and
exploding every session into each window that covers it multiplies the data. Instead
an entity is counted on the *first* day it appears in a window: on day ``s + j`` of
the window that starts on ``s``, exactly the entities whose previous appearance is
more than ``j`` days back are new. So the per-day counts "gap > j" are all that is
needed, and they come out of one ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_gap(df: DataFrame, group: list[str], entity: str, day: str, name: str = "gap_days") -> DataFrame:
    """Days since the same entity's previous day within its group; NULL on the first.

    ``df`` must hold one row per (group, entity, day), so a window partition has at
    most one row per calendar day, however many sessions the entity has.
    """
    previous = F.lag(day).over(Window.partitionBy(*group, entity).orderBy(day))
    return df.withColumn(name, F.datediff(F.col(day), previous))


def newcomer_counts(gap: Column, present: Column, longest: int, prefix: str) -> dict[str, Column]:
    """Aggregates ``{prefix}_j``: entities of the day not seen in the previous j days."""
    return {
        f"{prefix}_{j}": F.count_if(present & (gap.isNull() | (gap > j))) for j in range(longest)
    }


def rolling_sum(value: str, group: list[str], day_no: str, length: int, start: int = 0) -> str:
    """SQL text: sum of ``value`` over the days [day + start, day + length - 1] present.

    Text rather than Column objects: a voyage mart holds dozens of these, and one parsed
    expression each is far cheaper to build than a chain of window-builder calls.
    """
    return (
        f"sum({value}) OVER (PARTITION BY {', '.join(group)} ORDER BY {day_no} "
        f"RANGE BETWEEN {start} FOLLOWING AND {length - 1} FOLLOWING)"
    )


def rolling_distinct(prefix: str, group: list[str], day_no: str, length: int) -> str:
    """SQL text: exact distinct entities over [day, day + length - 1].

    Adds up the newcomers of each day of the window, see ``newcomer_counts``.
    """
    terms = [
        f"coalesce({rolling_sum(f'{prefix}_{j}', group, day_no, j + 1, start=j)}, 0L)"
        for j in range(length)
    ]
    return " + ".join(terms)
