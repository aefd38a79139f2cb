"""Sources, audits, KPI breakdowns, trends and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import labels
from spindrift.plans import kpis
from spindrift.registry.base import query, rounded, with_views
from spindrift.sources import parameters as P
from spindrift.sources import schemas, tables

M = with_views("members")
PL = with_views("plays")
MP = with_views("members", "plays")


@query("src01_member_scan", M + "SELECT * FROM members")
def member_scan(spark, sf):
    return tables.members(spark, sf)


@query(
    "src01_play_scan",
    PL
    + """SELECT play_order, play_part, play_machine, play_line, member_id, play_date, ship_name,
       CAST(denomination AS DOUBLE) AS denomination, num_spins, CAST(bet_per_spin AS DOUBLE) AS bet_per_spin,
       CAST(total_wagered AS DOUBLE) AS total_wagered, CAST(total_won AS DOUBLE) AS total_won,
       time_of_day FROM plays""",
)
def play_scan(spark, sf):
    return tables.plays(spark, sf).select(
        *tables.PLAY_KEY,
        "member_id",
        "play_date",
        "ship_name",
        F.col("denomination").cast("double"),
        "num_spins",
        F.col("bet_per_spin").cast("double"),
        F.col("total_wagered").cast("double"),
        F.col("total_won").cast("double"),
        "time_of_day",
    )


@query(
    "src02_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return schemas.duplicate_keys(tables.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "src02_orphans",
    """SELECT e.user_id AS member_id, count(*) AS n_rows FROM events e
       WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id) GROUP BY 1""",
)
def orphan_keys(spark, sf):
    child = tables.read(spark, sf, "events").select(F.col("user_id").alias("member_id"))
    parent = tables.read(spark, sf, "orders").select(F.col("o_custkey").alias("member_id"))
    return schemas.orphans(child, parent, "member_id")


@query(
    "src04_inline_relation",
    PL
    + """, t(time_of_day, ordinal) AS (VALUES ('Morning', 0), ('Afternoon', 1), ('Evening', 2), ('Night', 3))
    SELECT t.ordinal, p.time_of_day, count(*) AS sessions FROM plays p JOIN t USING (time_of_day) GROUP BY ALL""",
)
def inline_relation(spark, sf):
    slots = spark.createDataFrame(
        [(label, i) for i, label in enumerate(P.TIMES_OF_DAY)], "time_of_day string, ordinal int"
    )
    counted = tables.plays(spark, sf).groupBy("time_of_day").agg(F.count("*").alias("sessions"))
    return counted.join(F.broadcast(slots), "time_of_day").select("ordinal", "time_of_day", "sessions")


@query(
    "agg01_global_kpis",
    MP
    + f"""SELECT (SELECT count(*) FROM members) AS total_members, count(*) AS play_sessions,
      CAST(round(sum(total_wagered), 0) AS DOUBLE) AS total_wagered,
      (SELECT {rounded('avg(n)', 1)} FROM (SELECT count(*) AS n FROM plays GROUP BY member_id)) AS avg_sessions_per_member
      FROM plays""",
)
def global_kpis(spark, sf):
    return kpis.global_kpis(tables.members(spark, sf), tables.plays(spark, sf))


@query(
    "agg02_kpis_long",
    MP
    + f"""SELECT 'total_members' AS metric, CAST(count(*) AS DOUBLE) AS value FROM members
      UNION ALL SELECT 'play_sessions', CAST(count(*) AS DOUBLE) FROM plays
      UNION ALL SELECT 'total_wagered', CAST(round(sum(total_wagered), 0) AS DOUBLE) FROM plays
      UNION ALL SELECT 'avg_sessions', {rounded('avg(n)', 1)}
                FROM (SELECT count(*) AS n FROM plays GROUP BY member_id)""",
)
def kpis_long(spark, sf):
    return kpis.kpis_long(tables.members(spark, sf), tables.plays(spark, sf))


def _member_count(column):
    @query(
        f"agg03_members_by_{column}",
        M + f"SELECT {column}, count(*) AS members FROM members GROUP BY {column}",
    )
    def build(spark, sf):
        return kpis.count_by(tables.members(spark, sf), column, "members")


def _play_count(column):
    @query(
        f"agg03_sessions_by_{column}",
        PL + f"SELECT {column}, count(*) AS sessions FROM plays GROUP BY {column}",
    )
    def build(spark, sf):
        return kpis.count_by(tables.plays(spark, sf), column, "sessions")


for _column in ("membership_tier", "income_bracket", "home_state"):
    _member_count(_column)
for _column in ("game_name", "game_type", "time_of_day"):
    _play_count(_column)


@query(
    "agg04_age_by_gender",
    M
    + """SELECT CAST(age // 10 * 10 AS VARCHAR) || 's' AS age_group, gender, count(*) AS members
       FROM members GROUP BY ALL""",
)
def age_by_gender(spark, sf):
    return kpis.members_by_age_and_gender(tables.members(spark, sf))


@query(
    "agg05_revenue_by_denomination",
    PL
    + """SELECT CAST(denomination AS DOUBLE) AS denomination,
       CAST(round(sum(total_wagered), 0) AS DOUBLE) AS revenue, count(*) AS sessions FROM plays GROUP BY ALL""",
)
def revenue_by_denomination(spark, sf):
    return kpis.revenue_by_denomination(tables.plays(spark, sf)).withColumn(
        "denomination", F.col("denomination").cast("double")
    )


def _sessions_and_bet(column):
    @query(
        f"agg06_bet_by_{column}",
        PL
        + f"""SELECT {column}, count(*) AS sessions,
          {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet FROM plays GROUP BY {column}""",
    )
    def build(spark, sf):
        return kpis.sessions_and_bet(tables.plays(spark, sf), column)


for _column in ("time_of_day", "game_type"):
    _sessions_and_bet(_column)


@query(
    "agg07_monthly_trend",
    PL
    + """SELECT CAST(date_trunc('month', play_date) AS DATE) AS month,
       CAST(sum(total_wagered) AS DOUBLE) AS total_wagered, count(DISTINCT member_id) AS unique_players
       FROM plays GROUP BY 1""",
)
def monthly_trend(spark, sf):
    return kpis.monthly_trend(tables.plays(spark, sf))


@query(
    "agg07_monthly_trend_text",
    PL
    + """SELECT strftime(play_date, '%Y-%m') AS month,
       CAST(sum(total_wagered) AS DOUBLE) AS total_wagered, count(DISTINCT member_id) AS unique_players
       FROM plays WHERE ship_name = 'Ship C' GROUP BY 1""",
)
def monthly_trend_text(spark, sf):
    return kpis.monthly_trend(tables.plays(spark, sf), ship="Ship C", text_month=True)


@query(
    "agg07_monthly_trend_text_fleet",
    PL
    + """SELECT strftime(play_date, '%Y-%m') AS month,
       CAST(sum(total_wagered) AS DOUBLE) AS total_wagered, count(DISTINCT member_id) AS unique_players
       FROM plays GROUP BY 1""",
)
def monthly_trend_text_fleet(spark, sf):
    return kpis.monthly_trend(tables.plays(spark, sf, games=False), text_month=True)


SHIP_STATS = f"""count(DISTINCT member_id) AS unique_players,
  {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet,
  {rounded('CAST(sum(session_duration_mins) AS DOUBLE) / count(*)', 1)} AS avg_duration,
  {rounded('CAST(sum(total_won) AS DOUBLE) / nullif(CAST(sum(total_wagered) AS DOUBLE), 0) * 100', 1)} AS win_rate"""


@query("agg08_fleet_stats", PL + f"SELECT {SHIP_STATS} FROM plays")
def fleet_stats(spark, sf):
    return kpis.ship_statistics(tables.plays(spark, sf))


@query("agg08_ship_stats", PL + f"SELECT ship_name, {SHIP_STATS} FROM plays GROUP BY ship_name")
def ship_stats(spark, sf):
    return kpis.ship_statistics(tables.plays(spark, sf), by=("ship_name",))


@query("flt01_one_ship_stats", PL + f"SELECT {SHIP_STATS} FROM plays WHERE ship_name = 'Ship B'")
def one_ship_stats(spark, sf):
    return kpis.ship_statistics(tables.plays(spark, sf), ship="Ship B")


@query(
    "flt04_facet_filter",
    M
    + """SELECT member_id, gender, age FROM members
       WHERE membership_tier = 'Gold' AND risk_appetite = 'Moderate'""",
)
def facet_filter(spark, sf):
    chosen = kpis.facet_filter(
        tables.members(spark, sf), membership_tier="Gold", risk_appetite="Moderate", income_bracket=None
    )
    return chosen.select("member_id", "gender", "age")


@query(
    "flt04_match_counts",
    M
    + """SELECT membership_tier, risk_appetite, income_bracket, count(*) AS matches
       FROM members GROUP BY ALL""",
)
def match_counts(spark, sf):
    return (
        tables.members(spark, sf)
        .groupBy("membership_tier", "risk_appetite", "income_bracket")
        .agg(F.count("*").alias("matches"))
    )


@query(
    "flt09_set_membership",
    MP
    + """SELECT m.membership_tier, count(*) AS weekend_sessions FROM plays p JOIN members m USING (member_id)
       WHERE m.membership_tier IN ('Gold', 'Platinum') AND dayofweek(p.play_date) IN (0, 6) GROUP BY 1""",
)
def set_membership(spark, sf):
    weekend = tables.plays(spark, sf).where(F.weekday("play_date").isin(5, 6))
    per_member = weekend.groupBy("member_id").agg(F.count("*").alias("n"))
    high = tables.members(spark, sf).where(F.col("membership_tier").isin(*P.HIGH_TIER))
    return (
        per_member.join(high.select("member_id", "membership_tier"), "member_id")
        .groupBy("membership_tier")
        .agg(F.sum("n").alias("weekend_sessions"))
    )


@query(
    "flt10_between_dates",
    PL
    + """SELECT ship_name, count(*) AS sessions FROM plays
       WHERE play_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' GROUP BY ship_name""",
)
def between_dates(spark, sf):
    window = F.col("play_date").between(F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date"))
    return tables.plays(spark, sf).where(window).groupBy("ship_name").agg(F.count("*").alias("sessions"))


@query(
    "agg26_age_gender_wide",
    M
    + """SELECT CAST(age // 10 * 10 AS VARCHAR) || 's' AS age_group,
       count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender = 'F') AS female FROM members GROUP BY 1""",
)
def age_gender_wide(spark, sf):
    return kpis.age_gender_wide(tables.members(spark, sf))


@query(
    "agg28_row_counts",
    MP
    + """SELECT 'member_demographics' AS table_name, count(*) AS row_count, count(DISTINCT member_id) AS unique_keys FROM members
      UNION ALL SELECT 'slot_play_history', count(*), count(DISTINCT member_id) FROM plays
      UNION ALL SELECT 'policies', count(*), count(DISTINCT doc_id) FROM documents""",
)
def row_counts(spark, sf):
    return kpis.row_counts(
        {
            "member_demographics": (tables.members(spark, sf), "member_id"),
            "slot_play_history": (tables.plays(spark, sf), "member_id"),
            "policies": (tables.policies(spark, sf), "policy_id"),
        }
    )


@query("agg29_ship_facet", PL + "SELECT DISTINCT ship_name FROM plays")
def ship_facet(spark, sf):
    return kpis.facet_values(tables.plays(spark, sf), "ship_name")


@query("set02_distinct_pairs", PL + "SELECT DISTINCT ship_name, game_type FROM plays")
def distinct_pairs(spark, sf):
    return tables.plays(spark, sf).select("ship_name", "game_type").distinct()


@query(
    "agg30_distinct_counts",
    PL
    + """SELECT count(DISTINCT ship_name) AS ships, count(DISTINCT game_name) AS games,
       count(DISTINCT denomination) AS denominations FROM plays""",
)
def distinct_counts(spark, sf):
    return tables.plays(spark, sf).agg(
        F.countDistinct("ship_name").alias("ships"),
        F.countDistinct("game_name").alias("games"),
        F.countDistinct("denomination").alias("denominations"),
    )


@query(
    "top01_games_by_sessions",
    PL
    + "SELECT game_name, count(*) AS sessions FROM plays GROUP BY game_name ORDER BY sessions DESC, game_name LIMIT 10",
)
def games_by_sessions(spark, sf):
    return kpis.top_games_by_sessions(tables.plays(spark, sf))


@query(
    "top02_games_by_wagered",
    PL
    + """SELECT game_name, CAST(sum(total_wagered) AS DOUBLE) AS total_wagered FROM plays
       GROUP BY game_name ORDER BY sum(total_wagered) DESC, game_name LIMIT 5""",
)
def games_by_wagered(spark, sf):
    return kpis.top_games_by_wagered(tables.plays(spark, sf))


@query(
    "top04_home_states",
    M
    + "SELECT home_state, count(*) AS members FROM members GROUP BY 1 ORDER BY members DESC, home_state LIMIT 15",
)
def home_states(spark, sf):
    return kpis.top_states(tables.members(spark, sf))


@query(
    "top07_first_members",
    M
    + """SELECT member_id, membership_tier FROM members WHERE income_bracket = '$50K-$100K'
       ORDER BY member_id LIMIT 100""",
)
def first_members(spark, sf):
    chosen = kpis.facet_filter(tables.members(spark, sf), income_bracket="$50K-$100K")
    return chosen.select("member_id", "membership_tier").orderBy("member_id").limit(100)


@query(
    "rpt02_policy_listing",
    """SELECT lang AS category, count(*) AS policies, min(doc_id) AS first_id, max(doc_id) AS last_id
       FROM documents GROUP BY lang""",
)
def policy_listing(spark, sf):
    return (
        tables.policies(spark, sf)
        .groupBy("category")
        .agg(
            F.count("*").alias("policies"),
            F.min("policy_id").alias("first_id"),
            F.max("policy_id").alias("last_id"),
        )
    )


@query(
    "rpt02_policies_in_order",
    "SELECT doc_id AS policy_id, lang AS category, source AS title, text AS content FROM documents",
)
def policies_in_order(spark, sf):
    return kpis.policies_in_order(tables.policies(spark, sf))


@query(
    "scl12_denomination_labels",
    PL
    + """SELECT '$' || printf('%.2f', CAST(denomination AS DOUBLE)) AS label,
       format('{:,}', count(*)) AS sessions_text FROM plays GROUP BY denomination""",
)
def denomination_labels(spark, sf):
    return (
        tables.plays(spark, sf)
        .groupBy("denomination")
        .agg(F.count("*").alias("n"))
        .select(
            labels.denomination_label(F.col("denomination")).alias("label"),
            labels.thousands(F.col("n")).alias("sessions_text"),
        )
    )


@query(
    "rpt01_member_labels",
    M
    + """SELECT member_id, CAST(member_id AS VARCHAR) || ' — ' || gender || ', Age ' || CAST(age AS VARCHAR) || ', '
       || membership_tier || ', ' || risk_appetite || ' risk, ' || income_bracket AS label
       FROM members WHERE member_id IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""",
)
def member_labels(spark, sf):
    active = tables.plays(spark, sf).select("member_id").distinct()
    return tables.members(spark, sf).join(active, "member_id").select(
        "member_id", labels.member_label().alias("label")
    )
