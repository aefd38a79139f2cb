"""Registration of queries next to the independent SQL that checks them.

The SQL is written for DuckDB on the same parquet tables and shares no code with the
Spark side; ``VIEWS`` only spells out the member and session views a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MEMBERS_CTE = """
members AS (
  SELECT c_custkey AS member_id,
         CAST(21 + c_custkey % 60 AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Platinum' WHEN 'BUILDING' THEN 'Gold'
              WHEN 'FURNITURE' THEN 'Silver' WHEN 'HOUSEHOLD' THEN 'Bronze'
              WHEN 'MACHINERY' THEN 'Basic' END AS membership_tier,
         n_name AS home_state,
         DATE '1993-01-01' + CAST(c_custkey % 730 AS INTEGER) AS enrollment_date,
         CAST(1 + c_custkey % 20 AS INTEGER) AS total_cruises,
         c_acctbal AS lifetime_spend,
         CASE c_nationkey % 4 WHEN 0 THEN 'Conservative' WHEN 1 THEN 'Moderate'
              WHEN 2 THEN 'Aggressive' ELSE 'High Roller' END AS risk_appetite,
         CASE c_custkey % 4 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married'
              WHEN 2 THEN 'Divorced' ELSE 'Widowed' END AS marital_status,
         CASE c_nationkey % 5 WHEN 0 THEN 'Under $50K' WHEN 1 THEN '$50K-$100K'
              WHEN 2 THEN '$100K-$150K' WHEN 3 THEN '$150K-$250K'
              ELSE 'Over $250K' END AS income_bracket
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

PLAYS_CTE = """
plays_raw AS (
  SELECT l_orderkey AS play_order, l_partkey AS play_part, l_suppkey AS play_machine,
         l_linenumber AS play_line, o_custkey AS member_id,
         CAST(o_orderdate AS DATE) AS play_date,
         'Ship ' || chr(CAST(65 + l_suppkey % 8 AS INTEGER)) AS ship_name,
         CAST(CASE l_partkey % 9 WHEN 0 THEN 0.01 WHEN 1 THEN 0.05 WHEN 2 THEN 0.25
              WHEN 3 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 10 WHEN 6 THEN 20 WHEN 7 THEN 50
              ELSE 100 END AS DECIMAL(10,2)) AS denomination,
         p_brand AS game_name, p_type AS game_type,
         CAST(l_quantity * 10 AS INTEGER) AS num_spins,
         CAST(CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5
              ELSE 10 END AS DECIMAL(10,2)) AS bet_per_spin,
         CAST(0.85 + CAST(l_discount AS DECIMAL(4,2)) * CAST(2.5 AS DECIMAL(2,1)) AS DECIMAL(6,3)) AS payout,
         CAST(10 + l_orderkey % 110 AS INTEGER) AS session_duration_mins,
         CASE WHEN l_orderkey % 100 < 10 THEN 'Morning' WHEN l_orderkey % 100 < 33 THEN 'Afternoon'
              WHEN l_orderkey % 100 < 70 THEN 'Evening' ELSE 'Night' END AS time_of_day,
         CAST(((l_orderkey * 7919 + l_linenumber * 104729) % 10000) / 10000.0 AS DECIMAL(9,4)) AS u
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
plays_money AS (
  SELECT *,
         CAST(num_spins AS DECIMAL(8,0)) * CAST(bet_per_spin AS DECIMAL(8,2))
           * CAST(denomination AS DECIMAL(8,2)) AS stake
  FROM plays_raw),
plays AS (
  SELECT * EXCLUDE (stake),
         CAST(round(stake, 2) AS DECIMAL(18,2)) AS total_wagered,
         CAST(round(CAST(stake AS DECIMAL(24,4)) * CAST(payout AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS total_won,
         CAST(CAST(round(CAST(stake AS DECIMAL(24,4)) * CAST(payout AS DECIMAL(6,4)), 2) AS DECIMAL(18,2))
              - CAST(round(stake, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS net_result
  FROM plays_money)
"""

VIEWS = {"members": MEMBERS_CTE.strip(), "plays": PLAYS_CTE.strip()}


def with_views(*names: str, more: str = "") -> str:
    """WITH clause made of the named views and any further common table expressions."""
    parts = [VIEWS[n] for n in names] + ([more.strip().rstrip(",")] if more.strip() else [])
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(expression: str, digits: int) -> str:
    """The decimal half-up rounding of ``functions.numeric.round_half_up``, in SQL."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
