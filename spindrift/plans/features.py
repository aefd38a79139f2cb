"""Member feature mart, encoded training table and split report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import encode
from spindrift.functions.numeric import round_half_up
from spindrift.operators.evaluation import share_by_group
from spindrift.operators.split import hash_split
from spindrift.plans.kpis import average, win_rate
from spindrift.sources import parameters as P

# fixed values: feature columns used by the classifiers, in training order
FEATURE_COLUMNS = (
    "age",
    "gender_encoded",
    "tier_encoded",
    "risk_encoded",
    "marital_encoded",
    "income_encoded",
    "membership_days",
    "total_cruises",
    "lifetime_spend",
    "total_sessions",
    "total_spins",
    "avg_session_duration",
    "avg_spins_per_session",
    "ships_played",
    "games_played",
    "denominations_played",
    "bet_stddev",
    "win_rate_pct",
    "play_span_days",
)


def play_statistics(plays: DataFrame) -> DataFrame:
    """Twenty measures per member in one aggregation.

    The modes and distinct counts run over catalogue attributes (games, ships, prices,
    times of day), so their per-member buffers are bounded by the catalogue. They are
    combined map-side; ``collect_set`` avoids the row expansion that several
    COUNT(DISTINCT ...) would cause.
    """

    def most_common(column: str) -> Column:
        return F.mode(F.col(column), True)

    def variety(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("long")

    return plays.groupBy("member_id").agg(
        F.count("*").alias("total_sessions"),
        F.sum("num_spins").alias("total_spins"),
        average(F.col("bet_per_spin"), 2).alias("avg_bet_per_spin"),
        F.sum("total_wagered").alias("total_wagered"),
        F.sum("total_won").alias("total_won"),
        F.sum("net_result").alias("net_result"),
        average(F.col("session_duration_mins"), 0).alias("avg_session_duration"),
        average(F.col("num_spins"), 0).alias("avg_spins_per_session"),
        most_common("denomination").alias("preferred_denomination"),
        most_common("game_type").alias("preferred_game_type"),
        most_common("game_name").alias("preferred_game"),
        most_common("time_of_day").alias("preferred_time_of_day"),
        most_common("ship_name").alias("most_played_ship"),
        variety("ship_name").alias("ships_played"),
        variety("game_name").alias("games_played"),
        F.datediff(F.max("play_date"), F.min("play_date")).alias("play_span_days"),
        variety("denomination").alias("denominations_played"),
        round_half_up(F.stddev_samp("bet_per_spin"), 2).alias("bet_stddev"),
        win_rate(2).alias("win_rate_pct"),
    )


def member_features(members: DataFrame, plays: DataFrame, as_of: str) -> DataFrame:
    """Demographics joined to the play statistics; members without sessions drop out.

    Sessions are reduced to one row per member before the join, so the join input has
    unique keys on both sides.
    """
    stats = play_statistics(plays)
    membership = F.datediff(F.lit(as_of).cast("date"), F.col("enrollment_date"))
    return (
        members.withColumn("membership_days", membership)
        .drop("enrollment_date")
        .join(stats, "member_id")
        .withColumns({c: F.col(c).cast("double") for c in ("total_wagered", "total_won", "net_result")})
    )


def encoded(
    features: DataFrame,
    risks: tuple[str, ...] = P.RISKS,
    incomes: tuple[str, ...] = P.INCOMES,
    tiers: tuple[str, ...] = P.TIERS,
) -> DataFrame:
    """Training table: ordinal codes, numeric features, both targets and the split.

    Vocabularies are arguments; a value outside its vocabulary is encoded as NULL.
    """
    return features.select(
        "member_id",
        "age",
        encode.gender_code(F.col("gender")).alias("gender_encoded"),
        encode.ordinal(F.col("membership_tier"), tiers).alias("tier_encoded"),
        encode.ordinal(F.col("risk_appetite"), risks).alias("risk_encoded"),
        encode.ordinal(F.col("marital_status"), P.MARITAL).alias("marital_encoded"),
        encode.ordinal(F.col("income_bracket"), incomes).alias("income_encoded"),
        "membership_days",
        "total_cruises",
        "lifetime_spend",
        "total_sessions",
        "total_spins",
        "avg_session_duration",
        "avg_spins_per_session",
        "ships_played",
        "games_played",
        "denominations_played",
        "bet_stddev",
        "win_rate_pct",
        "total_wagered",
        "total_won",
        "play_span_days",
        "preferred_denomination",
        "avg_bet_per_spin",
        hash_split("member_id").alias("split"),
    )


def training_view(encoded_table: DataFrame, target: Column, name: str, split: str = "TRAIN") -> DataFrame:
    """Features and one target of a split; stakes, winnings and bets stay out (leakage)."""
    return encoded_table.where(F.col("split") == split).select(*FEATURE_COLUMNS, target.alias(name))


def split_report(encoded_table: DataFrame) -> DataFrame:
    return share_by_group(encoded_table, "split")
