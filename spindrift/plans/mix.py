"""Passenger-mix measures, weighted by sessions.

Sessions are aggregated per member first; a member's attributes are then joined once and
multiplied by the number of sessions, instead of joining every session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources import parameters as P


@dataclass(frozen=True)
class Groups:
    """Which attribute values count as high tier, high income and high risk."""

    tiers: tuple[str, ...] = P.HIGH_TIER
    incomes: tuple[str, ...] = P.HIGH_INCOME
    risks: tuple[str, ...] = P.HIGH_RISK


# fixed values: the narrower groups counted by the voyage mart
VOYAGE_GROUPS = Groups(("Platinum", "Diamond"), ("$100K-$150K", "Over $150K"), ("High",))


def flags(members: DataFrame, groups: Groups = Groups()) -> DataFrame:
    """One narrow row per member with the attributes the mix needs."""
    return members.select(
        "member_id",
        F.lit(True).alias("known"),
        "age",
        F.coalesce(F.col("gender") == "M", F.lit(False)).cast("int").alias("is_male"),
        _among("membership_tier", groups.tiers).alias("is_high_tier"),
        _among("income_bracket", groups.incomes).alias("is_high_income"),
        _among("risk_appetite", groups.risks).alias("is_high_risk"),
        "total_cruises",
        F.col("lifetime_spend").cast("decimal(18,4)").alias("spend"),
    )


def _among(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False)).cast("int")


def mix_sums(sessions: str = "sessions") -> dict[str, Column]:
    """Session-weighted sums over rows that found their member (``known``)."""
    n = F.col(sessions)
    return {
        "mix_sessions": F.sum(F.when(F.col("known"), n)),
        "mix_age": F.sum(n * F.col("age")),
        "mix_male": F.sum(n * F.col("is_male")),
        "mix_high_tier": F.sum(n * F.col("is_high_tier")),
        "mix_high_income": F.sum(n * F.col("is_high_income")),
        "mix_high_risk": F.sum(n * F.col("is_high_risk")),
        "mix_cruises": F.sum(n * F.col("total_cruises")),
        "mix_spend": F.sum(n.cast("decimal(12,0)") * F.col("spend")),
    }


MIX_COLUMNS = (
    "mix_sessions",
    "mix_age",
    "mix_male",
    "mix_high_tier",
    "mix_high_income",
    "mix_high_risk",
    "mix_cruises",
    "mix_spend",
)
