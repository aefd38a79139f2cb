"""Largest-remainder allocation of whole units to fractional shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allocate(df: DataFrame, keys: list[str], size: str, share_pct: str, order: str) -> DataFrame:
    """Add ``allocated``: integers that add up to ``size`` within every key group.

    ``share_pct`` are percentages that add up to 100. The units left after rounding
    down go to the largest remainders; equal remainders go to the lower ``order``.
    """
    group = Window.partitionBy(*keys)
    raw = F.col(share_pct) * F.col(size) / F.lit(100.0)
    parts = df.withColumn("_base", F.floor(raw).cast("int")).withColumn(
        "_rest", F.round(raw - F.col("_base"), 9)
    )
    rank = F.row_number().over(group.orderBy(F.desc("_rest"), order))
    short = F.col(size) - F.sum("_base").over(group)
    allocated = F.col("_base") + F.when(rank <= short, 1).otherwise(0)
    return parts.withColumn("allocated", allocated.cast("int")).drop("_base", "_rest")


def normalise(values: Column, total: float = 100.0) -> Column:
    """Scale an array so that its elements add up to ``total``; NULL for an all-zero array."""
    add_up = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    divisor = F.nullif(add_up, F.lit(0.0))
    return F.transform(values, lambda x: x / divisor * F.lit(total))


def allocate_array(shares_pct: Column, size: Column) -> Column:
    """The same rule for shares held in one array per row: no shuffle at all.

    Used where a row already carries its whole (short, fixed-length) share vector.
    """
    raw = F.transform(shares_pct, lambda p: p * size / F.lit(100.0))
    base = F.transform(raw, lambda r: F.floor(r).cast("int"))
    rest = F.transform(raw, lambda r: F.round(r - F.floor(r), 9))
    short = size - F.aggregate(base, F.lit(0), lambda acc, x: acc + x)
    # indices in the order in which the leftover units are handed out
    ordered = F.array_sort(F.transform(rest, lambda r, i: F.struct((-r).alias("r"), i.alias("i"))))
    winners = F.slice(F.transform(ordered, lambda s: s["i"]), F.lit(1), short)
    return F.transform(base, lambda b, i: (b + F.when(F.array_contains(winners, i), 1).otherwise(0)).cast("int"))


def first_max_index(values: Column) -> Column:
    """0-based position of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
