"""Demand-share regression for all denominations at once, and grouped validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.labels import share_column
from spindrift.functions.numeric import clip, ratio
from spindrift.ml import boosting
from spindrift.ml.boosting import Boosted
from spindrift.ml.estimators import DEMAND_BOOSTED, Trees
from spindrift.operators.allocate import normalise
from spindrift.plans.demand import mix_means
from spindrift.plans.mix import Groups, flags, mix_sums
from spindrift.sources import parameters as P
from spindrift.sources import workdir

CATEGORIES = ("ship_name",)
NUMBERS = (
    "avg_passenger_age",
    "pct_high_tier",
    "pct_high_income",
    "pct_high_risk",
    "avg_cruises",
    "avg_lifetime_spend",
    "unique_players",
)
TARGETS = tuple(share_column(float(d)) for d in P.DENOMINATIONS)


def monthly_demand(plays: DataFrame, members: DataFrame) -> DataFrame:
    """Training rows: one per ship and month, with the mix and nine demand shares.

    One pass over the sessions: they are counted by ship, month, member and price, and these counts
    carry the mix, the players and the shares.
    """
    price = F.col("denomination").cast("double")
    per_member = plays.groupBy("ship_name", F.trunc("play_date", "MM").alias("month"), "member_id").agg(
        F.count("*").alias("sessions"), *[F.count_if(price == float(d)).alias(f"_{t}") for d, t in zip(P.DENOMINATIONS, TARGETS, strict=True)]
    )
    joined = per_member.join(flags(members, Groups()), "member_id", "left")
    sums = {**mix_sums(), "unique_players": F.count("member_id"), **{f"_{t}": F.sum(f"_{t}") for t in TARGETS}, "_known": F.sum(sum((F.col(f"_{t}") for t in TARGETS), F.lit(0)))}
    monthly = joined.groupBy("ship_name", "month").agg(*[c.alias(n) for n, c in sums.items()]).where("mix_sessions > 0")
    shares = [ratio(F.col(f"_{t}") * 100.0, F.col("_known")).alias(t) for t in TARGETS]
    return monthly.select("ship_name", "month", *mix_means(), "unique_players", *shares)


def fit(train: DataFrame, trees: Trees = DEMAND_BOOSTED, group: str | None = None) -> Boosted:
    """One boosted model of all targets; with ``group`` also one without each of its values."""
    return boosting.fit(workdir.materialise(train, "demand-train"), TARGETS, CATEGORIES, NUMBERS, boosting.SQUARED, trees, group)


def predict(model: Boosted, rows: DataFrame, keep: Sequence[str], fold: Column | None = None) -> DataFrame:
    """Shares per row, clipped to [0, 100] and scaled back to 100; ``fold`` as in ``boosting.predict``."""
    scored = boosting.predict(model, rows, "_raw", fold)
    shares = scored.withColumn("_shares", normalise(F.transform("_raw", lambda s: clip(s, 0.0, 100.0))))
    return shares.select(*keep, *[F.get("_shares", F.lit(i)).alias(f"predicted_{t}") for i, t in enumerate(model.outputs)])


def leave_one_group_out(model: Boosted, rows: DataFrame, group: str) -> DataFrame:
    """Predictions for the rows of each group from the model of all other groups."""
    return predict(model, rows, ["ship_name", "month", *TARGETS], F.col(group).cast("string"))


def errors_by_target(predictions: DataFrame) -> DataFrame:
    """Long form (target, actual, predicted) for the regression metrics."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col(f"predicted_{t}").alias("predicted"))
            for t in TARGETS
        ]
    )
    return predictions.select(F.explode(cells).alias("c")).select("c.*")
