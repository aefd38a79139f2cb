"""Categorical assignment by inverse cumulative distribution, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of weights up to which their tables go to every task; more are joined on the group.
SENT_ROWS = 10_000


def intervals(weights: DataFrame, group: str, category: str, weight: str) -> DataFrame:
    """Half-open intervals (low, high] of running weight, with the group total.

    Bounds stay unnormalised sums, so they are exact for decimal weights.
    """
    ordered = Window.partitionBy(group).orderBy(category)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.sum(weight).over(running)
    table = weights.select(
        group, category, high.alias("high"), F.sum(weight).over(Window.partitionBy(group)).alias("total")
    )
    # the first interval also takes u = 0
    return table.withColumn("low", F.coalesce(F.lag("high").over(ordered), F.lit(-1)))


def cumulative_shares(weights: DataFrame, group: str, category: str, weight: str) -> DataFrame:
    """The CDF as a table: group, category, weight and cumulative share."""
    ordered = Window.partitionBy(group).orderBy(category)
    running = F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(weight).over(Window.partitionBy(group))
    return weights.withColumn("cdf_upper", running.cast("double") / total.cast("double"))


def assign_category_by_cdf(
    df: DataFrame,
    weights: DataFrame,
    u: str,
    group: str = "ship_name",
    category: str = "denomination",
    weight: str = "weight",
) -> DataFrame:
    """Give every row the first category whose cumulative share is at least ``u``.

    A group's bounds are one array in one row, so meeting them never multiplies a row, and the
    category is picked inside the row. Weights of at most ``SENT_ROWS`` rows (counted first) are
    sent to the tasks, so that rows need not move at all; larger tables are joined on the group,
    where Spark splits partitions that a large group makes uneven. Rows whose group has no weights,
    or whose ``u`` is null, are left out.
    """
    step = F.struct(F.col("high"), F.col(category).alias("category"))
    bounds = intervals(weights, group, category, weight)
    tables = bounds.groupBy(group).agg(F.array_sort(F.collect_list(step)).alias("_steps"), F.max("total").alias("_total"))
    few = weights.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    joined = df.drop(category).join(F.broadcast(tables) if few else tables, group)
    position = F.col(u) * F.col("_total")
    reached = F.get(F.filter("_steps", lambda s: s["high"] >= position), F.lit(0))["category"]
    return joined.withColumn(category, reached).where(F.col(category).isNotNull()).drop("_steps", "_total")
