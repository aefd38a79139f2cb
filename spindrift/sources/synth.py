"""Seeded data generation at any scale.

Each value is a function of (row id, column name, seed): a lost task recomputes the same
rows, and the number of partitions does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources import parameters as P
from spindrift.sources.tables import with_money

# fixed values: cumulative percentages of the generated attributes
TIER_STEPS = ((5, "Platinum"), (15, "Gold"), (30, "Silver"), (50, "Bronze"), (100, "Basic"))
# one draw against these steps; the shares are 10, 22.5, 37.1 and 30.4 percent
TIME_STEPS = ((100, "Morning"), (325, "Afternoon"), (696, "Evening"), (1000, "Night"))
# fixed value: number of generated games
GAMES = 15


def draw(name: str, n: int, seed: int = 42) -> Column:
    """Repeatable integer in [0, n) for the current row id and column name."""
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(n))


def choice(name: str, values: Sequence, seed: int, type_name: str = "string") -> Column:
    options = F.array(*[F.lit(v).cast(type_name) for v in values])
    return F.get(options, draw(name, len(values), seed).cast("int"))


def steps(name: str, table: Sequence[tuple[int, str]], seed: int) -> Column:
    u = draw(name, table[-1][0], seed)
    case = F.when(u < table[0][0], table[0][1])
    for upper, label in table[1:]:
        case = case.when(u < upper, label)
    return case


def member_rows(ids: DataFrame, as_of: str, seed: int = 42) -> DataFrame:
    """One generated member per row of ``ids`` (column ``id``)."""
    today = F.lit(as_of).cast("date")
    return ids.select(
        F.col("id").alias("member_id"),
        (F.lit(21) + draw("age", 60, seed)).cast("int").alias("age"),
        choice("gender", P.GENDERS, seed).alias("gender"),
        steps("tier", TIER_STEPS, seed).alias("membership_tier"),
        choice("state", P.HOME_STATES, seed).alias("home_state"),
        F.date_sub(today, draw("enrolled", 1825, seed).cast("int")).alias("enrollment_date"),
        (F.lit(1) + draw("cruises", 20, seed)).cast("int").alias("total_cruises"),
        (F.lit(1000) + draw("spend", 50000, seed)).cast("double").alias("lifetime_spend"),
        choice("risk", P.RISKS, seed).alias("risk_appetite"),
        choice("marital", P.MARITAL, seed).alias("marital_status"),
        choice("income", P.INCOMES, seed).alias("income_bracket"),
    )


def members(spark: SparkSession, n: int, as_of: str, seed: int = 42) -> DataFrame:
    """``n`` members with ids 1..n."""
    return member_rows(spark.range(1, n + 1), as_of, seed)


def play_rows(ids: DataFrame, n_members: int, as_of: str, seed: int = 42) -> DataFrame:
    """One generated session per row of ``ids``, over the 730 days up to ``as_of``."""
    today = F.lit(as_of).cast("date")
    games = [f"Game {i:02d}" for i in range(1, GAMES + 1)]
    rows = ids.select(
        F.col("id").alias("play_id"),
        (F.lit(1) + draw("member", n_members, seed)).alias("member_id"),
        F.date_sub(today, draw("date", 730, seed).cast("int")).alias("play_date"),
        choice("ship", P.SHIPS, seed).alias("ship_name"),
        choice("denomination", P.DENOMINATIONS, seed, "decimal(10,2)").alias("denomination"),
        choice("game", games, seed).alias("game_name"),
        choice("type", P.GAME_TYPES, seed).alias("game_type"),
        (F.lit(50) + draw("spins", 450, seed)).cast("int").alias("num_spins"),
        choice("bet", P.BETS, seed, "decimal(10,2)").alias("bet_per_spin"),
        (F.lit(10) + draw("minutes", 110, seed)).cast("int").alias("session_duration_mins"),
        steps("time", TIME_STEPS, seed).alias("time_of_day"),
        (draw("payout", 2500, seed) / F.lit(10000) + F.lit(0.85)).cast("decimal(6,4)").alias("payout"),
        (draw("u", 10000, seed).cast("decimal(9,4)") / F.lit(10000)).cast("decimal(9,4)").alias("u"),
    )
    return with_money(rows, F.col("payout"))


def plays(spark: SparkSession, n: int, n_members: int, as_of: str, seed: int = 42) -> DataFrame:
    """``n`` sessions of members 1..n_members."""
    return play_rows(spark.range(1, n + 1), n_members, as_of, seed)
