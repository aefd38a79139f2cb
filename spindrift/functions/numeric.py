"""Numeric column helpers shared by every mart.

Money is kept as DECIMAL until the last projection so that sums do not depend on
the order in which partial aggregates are merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL instead of raising when the divisor is 0."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double through DECIMAL, so that 2.675 rounds to 2.68 on every engine."""
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def exact_avg(value: Column) -> Column:
    """Average of a double column summed as DECIMAL (independent of merge order)."""
    as_decimal = value.cast("decimal(28,12)")
    return ratio(F.sum(as_decimal), F.count(as_decimal))


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def uniform(*keys: Column | str, salt: str) -> Column:
    """Repeatable draw from [0, 1) decided by the key alone.

    The digest makes the draw the same on any cluster layout, after any retry and in
    any other engine that has MD5.
    """
    text = F.concat_ws(":", F.lit(salt), *[F.col(k) if isinstance(k, str) else k for k in keys])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)
