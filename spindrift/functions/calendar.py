"""Calendar columns. Both weekday conventions exist, so the name states which one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dow_sun0(day: Column) -> Column:
    return F.dayofweek(day) - 1


def dow_mon0(day: Column) -> Column:
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day).isin(5, 6).cast("int")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_number(day: Column) -> Column:
    """Days since the epoch: lets window RANGE frames be written in whole days."""
    return F.unix_date(day)


def with_calendar(df: DataFrame, day: str) -> DataFrame:
    """Month, Monday-based weekday and weekend flag of ``day`` as model features."""
    column = F.col(day)
    return df.withColumns(
        {
            "play_month": F.month(column),
            "dow_mon0": dow_mon0(column),
            "is_weekend": is_weekend(column),
        }
    )
