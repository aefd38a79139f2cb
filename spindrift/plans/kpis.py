"""Dashboard KPIs, breakdowns, trends and top-k lists.

Every report is one aggregation over the session or member table. Grouping keys are
low-cardinality attributes, so map-side partial aggregation leaves a handful of rows
per task to shuffle, whatever the share of the largest group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import calendar, labels
from spindrift.functions.numeric import ratio, round_half_up


def only_ship(plays: DataFrame, ship: str | None) -> DataFrame:
    """Optional equality filter; ``None`` means the whole fleet."""
    return plays if ship is None else plays.where(F.col("ship_name") == F.lit(ship))


def facet_filter(df: DataFrame, **facets: str | None) -> DataFrame:
    """Conjunction of the facets that are set."""
    for column, value in facets.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def global_kpis(members: DataFrame, plays: DataFrame) -> DataFrame:
    """Members, sessions, money wagered and sessions per active member, as one row.

    Sessions per member is (sessions / distinct players): the same value as averaging
    a per-member count, without building the per-member table.
    """
    session_side = plays.agg(
        F.count("*").alias("play_sessions"),
        F.round(F.sum("total_wagered"), 0).cast("double").alias("total_wagered"),
        round_half_up(ratio(F.count("member_id"), F.countDistinct("member_id")), 1).alias(
            "avg_sessions_per_member"
        ),
    )
    total = members.agg(F.count("*").alias("total_members"))
    # both sides are single-row aggregates
    return session_side.select(total.scalar().alias("total_members"), "*")


def kpis_long(members: DataFrame, plays: DataFrame) -> DataFrame:
    """The KPIs as (metric, value) rows: each input is read once, then unpivoted."""
    play_side = plays.agg(
        F.count("*").cast("double").alias("play_sessions"),
        F.round(F.sum("total_wagered"), 0).cast("double").alias("total_wagered"),
        round_half_up(ratio(F.count("member_id"), F.countDistinct("member_id")), 1).alias("avg_sessions"),
    ).unpivot([], ["play_sessions", "total_wagered", "avg_sessions"], "metric", "value")
    member_side = members.agg(F.count("*").cast("double").alias("total_members")).unpivot(
        [], ["total_members"], "metric", "value"
    )
    return member_side.unionByName(play_side)


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Row count per attribute value, largest first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def members_by_age_and_gender(members: DataFrame) -> DataFrame:
    return (
        members.groupBy(labels.decade_label(F.col("age")).alias("age_group"), "gender")
        .agg(F.count("*").alias("members"))
        .orderBy("age_group", "gender")
    )


def age_gender_wide(members: DataFrame) -> DataFrame:
    """One row per decade with a column per gender; absent combinations are 0."""
    return (
        members.groupBy(labels.decade_label(F.col("age")).alias("age_group"))
        .pivot("gender", ["M", "F"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .select("age_group", F.col("M").alias("male"), F.col("F").alias("female"))
    )


def revenue_by_denomination(plays: DataFrame, ship: str | None = None) -> DataFrame:
    return (
        only_ship(plays, ship)
        .groupBy("denomination")
        .agg(
            F.round(F.sum("total_wagered"), 0).cast("double").alias("revenue"),
            F.count("*").alias("sessions"),
        )
        .orderBy("denomination")
    )


def sessions_and_bet(plays: DataFrame, by: str, ship: str | None = None) -> DataFrame:
    return (
        only_ship(plays, ship)
        .groupBy(by)
        .agg(F.count("*").alias("sessions"), average(F.col("bet_per_spin"), 2).alias("avg_bet"))
        .orderBy(F.desc("sessions"), by)
    )


def average(value: Column, digits: int) -> Column:
    """Average of an exact (integer or decimal) column, rounded half-up."""
    return round_half_up(ratio(F.sum(value), F.count(value)), digits)


def monthly_trend(plays: DataFrame, ship: str | None = None, text_month: bool = False) -> DataFrame:
    month = calendar.month_label if text_month else calendar.month_start
    return (
        only_ship(plays, ship)
        .groupBy(month(F.col("play_date")).alias("month"))
        .agg(
            F.sum("total_wagered").cast("double").alias("total_wagered"),
            F.countDistinct("member_id").alias("unique_players"),
        )
        .orderBy("month")
    )


def ship_statistics(plays: DataFrame, ship: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Players, average bet and duration, and payout ratio; optionally per group."""
    return (
        only_ship(plays, ship)
        .groupBy(*by)
        .agg(
            F.countDistinct("member_id").alias("unique_players"),
            average(F.col("bet_per_spin"), 2).alias("avg_bet"),
            average(F.col("session_duration_mins"), 1).alias("avg_duration"),
            win_rate(1).alias("win_rate"),
        )
    )


def win_rate(digits: int) -> Column:
    """Money won per money wagered in percent: a ratio of sums, NULL without wagers."""
    return round_half_up(
        ratio(F.sum("total_won"), F.sum("total_wagered")) * F.lit(100.0), digits
    )


def top_games_by_sessions(plays: DataFrame, k: int = 10, ship: str | None = None) -> DataFrame:
    return count_by(only_ship(plays, ship), "game_name", "sessions").limit(k)


def top_games_by_wagered(plays: DataFrame, k: int = 5) -> DataFrame:
    return (
        plays.groupBy("game_name")
        .agg(F.sum("total_wagered").alias("total_wagered"))
        .orderBy(F.desc("total_wagered"), "game_name")
        .limit(k)
        .withColumn("total_wagered", F.col("total_wagered").cast("double"))
    )


def top_members(features: DataFrame, k: int = 10) -> DataFrame:
    return (
        features.select(
            "member_id",
            "total_wagered",
            "total_won",
            "win_rate_pct",
            "membership_tier",
            "preferred_denomination",
        )
        .orderBy(F.desc("total_wagered"), "member_id")
        .limit(k)
    )


def top_states(members: DataFrame, k: int = 15) -> DataFrame:
    return count_by(members, "home_state", "members").limit(k)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def row_counts(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and distinct keys per table: {name: (frame, key)} -> one row each."""
    audits = [
        df.agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("unique_keys")).select(
            F.lit(name).alias("table_name"), "row_count", "unique_keys"
        )
        for name, (df, key) in tables.items()
    ]
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


def latest_policies(policies: DataFrame, key: str, updated: str) -> DataFrame:
    """One row per key: the most recently updated one (map-side reducible arg-max)."""
    others = [c for c in policies.columns if c != key]
    newest = F.max_by(F.struct(*others), F.struct(F.col(updated), F.struct(*others)))
    return policies.groupBy(key).agg(newest.alias("row")).select(key, "row.*")


def policies_in_order(policies: DataFrame) -> DataFrame:
    return policies.orderBy("category", "policy_id")


def slot_dashboard(plays: DataFrame, ship: str | None = None) -> dict[str, DataFrame]:
    return {
        "ships": facet_values(plays, "ship_name"),
        "stats": ship_statistics(plays, ship),
        "denominations": revenue_by_denomination(plays, ship),
        "games": top_games_by_sessions(plays, 10, ship),
        "time_of_day": sessions_and_bet(plays, "time_of_day", ship),
        "game_types": sessions_and_bet(plays, "game_type", ship),
        "monthly": monthly_trend(plays, ship, text_month=True),
    }


def member_dashboard(members: DataFrame, plays: DataFrame) -> dict[str, DataFrame]:
    return {
        "kpis": kpis_long(members, plays),
        "tiers": count_by(members, "membership_tier", "members"),
        "ages": members_by_age_and_gender(members),
        "income": count_by(members, "income_bracket", "members"),
        "states": top_states(members),
    }
