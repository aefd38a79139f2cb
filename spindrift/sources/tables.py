"""Readers, and the views that present the star-schema tables as gaming tables.

The views are plain projections and equi-joins, so column pruning and filter pushdown
reach the parquet scans. No join carries a broadcast hint: the inputs grow, and
Spark's own size estimate (and AQE at run time) decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import encode
from spindrift.sources import parameters as P

# fixed values: how the market segments stand in for loyalty tiers
SEGMENT_TIERS = {
    "AUTOMOBILE": "Platinum",
    "BUILDING": "Gold",
    "FURNITURE": "Silver",
    "HOUSEHOLD": "Bronze",
    "MACHINERY": "Basic",
}
# fixed value: the product type that stands in for progressive machines
PROGRESSIVE_TYPE = "PROMO"
PLAY_KEY = ("play_order", "play_part", "play_machine", "play_line")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values, position: Column, type_name: str) -> Column:
    literals = F.array(*[F.lit(v).cast(type_name) for v in values])
    return F.element_at(literals, (position + 1).cast("int"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_state")
    )
    key, home = F.col("c_custkey"), F.col("c_nationkey")
    return customer.join(nation, "c_nationkey").select(
        key.alias("member_id"),
        (F.lit(21) + key % 60).cast("int").alias("age"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
        encode.decode(F.col("c_mktsegment"), SEGMENT_TIERS).alias("membership_tier"),
        "home_state",
        F.date_add(F.lit("1993-01-01").cast("date"), (key % 730).cast("int")).alias("enrollment_date"),
        (F.lit(1) + key % 20).cast("int").alias("total_cruises"),
        F.col("c_acctbal").alias("lifetime_spend"),
        _pick(P.RISKS, home % 4, "string").alias("risk_appetite"),
        _pick(P.MARITAL, key % 4, "string").alias("marital_status"),
        _pick(P.INCOMES, home % 5, "string").alias("income_bracket"),
    )


def wagered(spins: Column, bet: Column, denomination: Column) -> Column:
    """Exact stake of a session; the narrow factors keep the product inside DECIMAL(38)."""
    product = spins.cast("decimal(8,0)") * bet.cast("decimal(8,2)") * denomination.cast("decimal(8,2)")
    return F.round(product, 2).cast("decimal(18,2)")


def won(spins: Column, bet: Column, denomination: Column, payout: Column) -> Column:
    product = (
        spins.cast("decimal(8,0)")
        * bet.cast("decimal(8,2)")
        * denomination.cast("decimal(8,2)")
        * payout.cast("decimal(6,4)")
    )
    return F.round(product, 2).cast("decimal(18,2)")


def with_money(df: DataFrame, payout: Column) -> DataFrame:
    """Derive stake, winnings and net result from spins, bet, denomination and payout."""
    spins, bet, denom = F.col("num_spins"), F.col("bet_per_spin"), F.col("denomination")
    return df.withColumns(
        {"total_wagered": wagered(spins, bet, denom), "total_won": won(spins, bet, denom, payout)}
    ).withColumn("net_result", (F.col("total_won") - F.col("total_wagered")).cast("decimal(18,2)"))


def plays(spark: SparkSession, sf_dir: str, games: bool = True) -> DataFrame:
    """One row per session, keyed by the four columns of PLAY_KEY.

    Without ``games`` the two game columns and the join that brings them are left out; the rows are
    the same as long as every session's game is known (``schemas.orphans`` tells).
    """
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").cast("date").alias("play_date"),
    )
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("game_name"),
        F.col("p_type").alias("game_type"),
    )
    hour = F.col("l_orderkey") % 100
    played = lines.join(orders, "l_orderkey")
    played = played.join(parts, "l_partkey") if games else played
    sessions = played.select(
        F.col("l_orderkey").alias("play_order"),
        F.col("l_partkey").alias("play_part"),
        F.col("l_suppkey").alias("play_machine"),
        F.col("l_linenumber").alias("play_line"),
        "member_id",
        "play_date",
        F.concat(F.lit("Ship "), F.char(F.lit(65) + F.col("l_suppkey") % 8)).alias("ship_name"),
        _pick(P.DENOMINATIONS, F.col("l_partkey") % 9, "decimal(10,2)").alias("denomination"),
        *(["game_name", "game_type"] if games else []),
        (F.col("l_quantity") * 10).cast("int").alias("num_spins"),
        _pick(P.BETS, F.col("l_linenumber") % 5, "decimal(10,2)").alias("bet_per_spin"),
        (
            F.lit("0.85").cast("decimal(3,2)")
            + F.col("l_discount").cast("decimal(4,2)") * F.lit("2.5").cast("decimal(2,1)")
        )
        .cast("decimal(6,3)")
        .alias("payout"),
        (F.lit(10) + F.col("l_orderkey") % 110).cast("int").alias("session_duration_mins"),
        F.when(hour < 10, "Morning")
        .when(hour < 33, "Afternoon")
        .when(hour < 70, "Evening")
        .otherwise("Night")
        .alias("time_of_day"),
        (
            ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10000).cast("decimal(10,0)")
            / F.lit(10000).cast("decimal(5,0)")
        )
        .cast("decimal(9,4)")
        .alias("u"),
    )
    return with_money(sessions, F.col("payout"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of policy texts."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("policy_id"),
        F.col("lang").alias("category"),
        F.col("source").alias("title"),
        F.col("text").alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose the logical tables to ``spark.sql``."""
    members(spark, sf_dir).createOrReplaceTempView("member_demographics")
    plays(spark, sf_dir).createOrReplaceTempView("slot_play_history")
    policies(spark, sf_dir).createOrReplaceTempView("house_policies")
