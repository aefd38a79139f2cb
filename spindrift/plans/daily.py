"""Daily ship mart and the chronological training table built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import calendar, encode
from spindrift.functions.numeric import ratio, round_half_up
from spindrift.operators.split import chronological_split
from spindrift.sources import parameters as P

# fixed values: inputs of the win-rate classifier, in training order
WIN_RATE_FEATURES = (
    "ship_encoded",
    "dow_sun0",
    "month_num",
    "sessions",
    "unique_players",
    "avg_spins",
    "avg_bet_per_spin",
    "daily_wagered",
    "avg_session_mins",
    "night_sessions",
    "evening_sessions",
    "progressive_sessions",
)


def session_sums(progressive_type: str = "Progressive") -> list[Column]:
    return [
        F.count("*").alias("sessions"),
        F.sum("num_spins").alias("spins"),
        F.sum("bet_per_spin").alias("bets"),
        F.sum("total_wagered").alias("wagered"),
        F.sum("total_won").alias("won"),
        F.sum("session_duration_mins").alias("minutes"),
        F.count_if(F.col("time_of_day") == "Night").alias("night"),
        F.count_if(F.col("time_of_day") == "Evening").alias("evening"),
        F.count_if(F.col("game_type") == progressive_type).alias("progressive"),
    ]


def member_days(plays: DataFrame, progressive_type: str = "Progressive") -> DataFrame:
    """Sessions reduced to one row per (ship, day, member).

    The shared base of the demand-mix and voyage marts. All measures are sums or
    counts, so they combine map-side and a very active member costs at most one row per
    ship and day from here on.
    """
    return plays.groupBy("ship_name", "play_date", "member_id").agg(*session_sums(progressive_type))


def ship_days(plays: DataFrame, progressive_type: str = "Progressive") -> DataFrame:
    """Sessions reduced to one row per (ship, day).

    Spark counts the distinct players by way of one row per ship, day and member; a query that does
    not ask for the players shuffles ship days only.
    """
    players = F.count_distinct("member_id").alias("unique_players")
    return plays.groupBy("ship_name", "play_date").agg(*session_sums(progressive_type), players)


def daily_metrics(plays: DataFrame, progressive_type: str = "Progressive") -> DataFrame:
    """Thirteen measures per ship and day."""
    days = ship_days(plays, progressive_type)
    n = F.col("sessions")
    return days.select(
        "ship_name",
        "play_date",
        calendar.dow_sun0(F.col("play_date")).alias("dow_sun0"),
        F.month("play_date").alias("month_num"),
        "sessions",
        "unique_players",
        round_half_up(ratio(F.col("spins"), n), 1).alias("avg_spins"),
        round_half_up(ratio(F.col("bets"), n), 2).alias("avg_bet_per_spin"),
        F.col("wagered").cast("double").alias("daily_wagered"),
        F.col("won").cast("double").alias("daily_won"),
        round_half_up(ratio(F.col("won"), F.col("wagered")) * 100, 2).alias("win_rate_pct"),
        round_half_up(ratio(F.col("minutes"), n), 1).alias("avg_session_mins"),
        F.col("night").alias("night_sessions"),
        F.col("evening").alias("evening_sessions"),
        F.col("progressive").alias("progressive_sessions"),
    )


def win_rate_training(daily: DataFrame, ships: tuple[str, ...] = P.SHIPS) -> DataFrame:
    """Daily rows with ship code, global position, chronological split and win-rate bin."""
    split = chronological_split(daily, "play_date", ["ship_name"])
    return split.withColumns(
        {
            "ship_encoded": encode.ordinal(F.col("ship_name"), ships),
            "win_rate_category": encode.win_rate_category(F.col("win_rate_pct")),
        }
    )


def win_rate_view(training: DataFrame, split: str = "TRAIN") -> DataFrame:
    return training.where(F.col("split") == split).select(*WIN_RATE_FEATURES, "win_rate_category")
