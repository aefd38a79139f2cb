"""Member features, daily ship mart, demand mart, redistribution and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import calendar, encode
from spindrift.functions.labels import share_column
from spindrift.functions.numeric import clip, round_half_up, uniform
from spindrift.operators import cdf, evaluation, pick, split
from spindrift.plans import daily, demand, features, kpis
from spindrift.registry.base import query, rounded, with_views
from spindrift.sources import parameters as P
from spindrift.sources import tables

AS_OF = "2002-01-01"
M = with_views("members")
PL = with_views("plays")

MODES = "\n".join(
    f"""mode_{column} AS (SELECT member_id, {column} FROM (
  SELECT member_id, {column}, row_number() OVER (PARTITION BY member_id ORDER BY count(*) DESC, {column}) AS rn
  FROM plays GROUP BY member_id, {column}) WHERE rn = 1),"""
    for column in ("denomination", "game_type", "game_name", "time_of_day", "ship_name")
)

FEATURES_CTE = f"""{MODES}
stats AS (SELECT member_id, count(*) AS total_sessions, CAST(sum(num_spins) AS BIGINT) AS total_spins,
  {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet_per_spin,
  CAST(sum(total_wagered) AS DOUBLE) AS total_wagered, CAST(sum(total_won) AS DOUBLE) AS total_won,
  CAST(sum(net_result) AS DOUBLE) AS net_result,
  {rounded('CAST(sum(session_duration_mins) AS DOUBLE) / count(*)', 0)} AS avg_session_duration,
  {rounded('CAST(sum(num_spins) AS DOUBLE) / count(*)', 0)} AS avg_spins_per_session,
  count(DISTINCT ship_name) AS ships_played, count(DISTINCT game_name) AS games_played,
  CAST(max(play_date) - min(play_date) AS INTEGER) AS play_span_days,
  count(DISTINCT denomination) AS denominations_played,
  {rounded('stddev_samp(CAST(bet_per_spin AS DOUBLE))', 2)} AS bet_stddev,
  {rounded('CAST(sum(total_won) AS DOUBLE) / nullif(CAST(sum(total_wagered) AS DOUBLE), 0) * 100', 2)} AS win_rate_pct
  FROM plays GROUP BY member_id),
features AS (SELECT m.* EXCLUDE (enrollment_date),
  CAST(DATE '{AS_OF}' - m.enrollment_date AS INTEGER) AS membership_days, s.* EXCLUDE (member_id),
  CAST(d.denomination AS DOUBLE) AS preferred_denomination, t.game_type AS preferred_game_type,
  g.game_name AS preferred_game, o.time_of_day AS preferred_time_of_day, h.ship_name AS most_played_ship
  FROM members m JOIN stats s USING (member_id) JOIN mode_denomination d USING (member_id)
  JOIN mode_game_type t USING (member_id) JOIN mode_game_name g USING (member_id)
  JOIN mode_time_of_day o USING (member_id) JOIN mode_ship_name h USING (member_id))"""
FEATURES = with_views("members", "plays", more=FEATURES_CTE)


def _plays(spark, sf, plays):
    """The sessions, read from the tables unless a query has them already."""
    return tables.plays(spark, sf) if plays is None else plays


def member_features(spark, sf, plays=None):
    built = features.member_features(tables.members(spark, sf), _plays(spark, sf, plays), AS_OF)
    return built.withColumn("preferred_denomination", F.col("preferred_denomination").cast("double"))


query("fea01_member_features", FEATURES + "SELECT * FROM features")(member_features)
query("agg09_member_aggregates", FEATURES + "SELECT * EXCLUDE (preferred_denomination) FROM features")(
    lambda spark, sf: member_features(spark, sf).drop("preferred_denomination")
)


@query(
    "agg10_global_modes",
    PL
    + """, d AS (SELECT denomination AS v, row_number() OVER (ORDER BY count(*) DESC, denomination) AS rn FROM plays GROUP BY 1),
    b AS (SELECT CASE WHEN bet_per_spin <= 2 THEN 'Low' WHEN bet_per_spin <= 4 THEN 'Medium'
                 WHEN bet_per_spin <= 7 THEN 'High' ELSE 'VeryHigh' END AS c FROM plays),
    bb AS (SELECT c AS v, row_number() OVER (ORDER BY count(*) DESC, c) AS rn FROM b GROUP BY 1)
    SELECT (SELECT CAST(v AS DOUBLE) FROM d WHERE rn = 1) AS denomination, (SELECT v FROM bb WHERE rn = 1) AS bet_category""",
)
def global_modes(spark, sf):
    return tables.plays(spark, sf, games=False).agg(
        F.mode("denomination", True).cast("double").alias("denomination"),
        F.mode(encode.bet_category(F.col("bet_per_spin")), True).alias("bet_category"),
    )


@query(
    "agg11_bet_stddev",
    PL
    + f"""SELECT ship_name, game_type, {rounded('stddev_samp(CAST(bet_per_spin AS DOUBLE))', 4)} AS bet_stddev
       FROM plays GROUP BY ALL""",
)
def bet_stddev(spark, sf):
    return (
        tables.plays(spark, sf)
        .groupBy("ship_name", "game_type")
        .agg(round_half_up(F.stddev_samp("bet_per_spin"), 4).alias("bet_stddev"))
    )


@query(
    "top03_members_by_wagered",
    FEATURES
    + """SELECT member_id, total_wagered, total_won, win_rate_pct, membership_tier, preferred_denomination
      FROM features ORDER BY total_wagered DESC, member_id LIMIT 10""",
)
def members_by_wagered(spark, sf):
    return kpis.top_members(member_features(spark, sf))


ENCODED_CTE = (
    FEATURES_CTE
    + """,
encoded AS (SELECT member_id, age, CASE gender WHEN 'M' THEN 1 ELSE 0 END AS gender_encoded,
  CASE membership_tier WHEN 'Basic' THEN 0 WHEN 'Bronze' THEN 1 WHEN 'Silver' THEN 2 WHEN 'Gold' THEN 3
       WHEN 'Platinum' THEN 4 END AS tier_encoded,
  CASE risk_appetite WHEN 'Conservative' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Aggressive' THEN 2
       WHEN 'High Roller' THEN 3 END AS risk_encoded,
  CASE marital_status WHEN 'Single' THEN 0 WHEN 'Married' THEN 1 WHEN 'Divorced' THEN 2 WHEN 'Widowed' THEN 3 END AS marital_encoded,
  CASE income_bracket WHEN 'Under $50K' THEN 0 WHEN '$50K-$100K' THEN 1 WHEN '$100K-$150K' THEN 2
       WHEN '$150K-$250K' THEN 3 WHEN 'Over $250K' THEN 4 END AS income_encoded,
  membership_days, total_cruises, lifetime_spend, total_sessions, total_spins, avg_session_duration,
  avg_spins_per_session, ships_played, games_played, denominations_played, bet_stddev, win_rate_pct,
  total_wagered, total_won, play_span_days, preferred_denomination, avg_bet_per_spin,
  CASE WHEN u < 0.7 THEN 'TRAIN' WHEN u < 0.85 THEN 'VALIDATION' ELSE 'TEST' END AS split
  FROM (SELECT *, CAST(CAST('0x' || substr(md5('split:' || CAST(member_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)
               / 4294967296.0 AS u FROM features))"""
)
ENCODED = with_views("members", "plays", more=ENCODED_CTE)


def encoded(spark, sf, plays=None):
    return features.encoded(member_features(spark, sf, plays))


query("fea02_training_table", ENCODED + "SELECT * FROM encoded")(encoded)


@query(
    "fea03_split_report",
    ENCODED
    + f"""SELECT split, count(*) AS n,
      {rounded('count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS percentage FROM encoded GROUP BY split""",
)
def split_report(spark, sf):
    return features.split_report(encoded(spark, sf))


@query(
    "prj02_bet_training_view",
    ENCODED
    + f"""SELECT {', '.join(features.FEATURE_COLUMNS)},
      CASE WHEN avg_bet_per_spin <= 2 THEN 'Low' WHEN avg_bet_per_spin <= 4 THEN 'Medium'
           WHEN avg_bet_per_spin <= 7 THEN 'High' ELSE 'VeryHigh' END AS bet_category
      FROM encoded WHERE split = 'TRAIN'""",
)
def bet_training_view(spark, sf):
    return features.training_view(
        encoded(spark, sf), encode.bet_category(F.col("avg_bet_per_spin")), "bet_category"
    )


@query(
    "jon03_member_profiles",
    FEATURES
    + """SELECT member_id, age, gender, membership_tier, risk_appetite, income_bracket, marital_status,
      total_cruises, lifetime_spend, total_sessions, total_spins, avg_bet_per_spin,
      preferred_denomination AS actual_pref_denom, win_rate_pct FROM features""",
)
def member_profiles(spark, sf):
    return member_features(spark, sf).select(
        "member_id",
        "age",
        "gender",
        "membership_tier",
        "risk_appetite",
        "income_bracket",
        "marital_status",
        "total_cruises",
        "lifetime_spend",
        "total_sessions",
        "total_spins",
        "avg_bet_per_spin",
        F.col("preferred_denomination").alias("actual_pref_denom"),
        "win_rate_pct",
    )


@query(
    "flt06_point_lookup",
    FEATURES + "SELECT member_id, total_sessions, preferred_game FROM features WHERE member_id = 101",
)
def point_lookup(spark, sf):
    """The id predicate reaches the scans of both inputs."""
    wanted = F.col("member_id") == 101
    members = tables.members(spark, sf).where(wanted)
    plays = tables.plays(spark, sf).where(wanted)
    return features.member_features(members, plays, AS_OF).select(
        "member_id", "total_sessions", "preferred_game"
    ).limit(1)


@query(
    "jon02_training_rows",
    with_views("members", "plays")
    + """SELECT ship_name, CAST(month(play_date) AS INTEGER) AS play_month,
      CAST((dayofweek(play_date) + 6) % 7 AS INTEGER) AS dow_mon0,
      CASE WHEN dayofweek(play_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
      game_type, age, gender, membership_tier, total_cruises, risk_appetite, income_bracket,
      CAST(denomination AS DOUBLE) AS denomination FROM plays JOIN members USING (member_id)""",
)
def training_rows(spark, sf):
    joined = tables.plays(spark, sf).join(tables.members(spark, sf), "member_id")
    return calendar.with_calendar(joined, "play_date").select(
        "ship_name",
        "play_month",
        "dow_mon0",
        "is_weekend",
        "game_type",
        "age",
        "gender",
        "membership_tier",
        "total_cruises",
        "risk_appetite",
        "income_bracket",
        F.col("denomination").cast("double"),
    )


LATEST_CTE = """latest AS (SELECT member_id, ship_name, play_date FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id
    ORDER BY play_date DESC, play_order DESC, play_part DESC, play_machine DESC, play_line DESC) AS rn FROM plays)
  WHERE rn = 1)"""


@query(
    "jon05_latest_ship",
    with_views("members", "plays", more=LATEST_CTE)
    + """SELECT m.member_id, m.membership_tier, l.ship_name AS last_ship, l.play_date AS last_date
      FROM members m LEFT JOIN latest l USING (member_id)""",
)
def latest_ship(spark, sf):
    newest = pick.latest(
        tables.plays(spark, sf, games=False), "member_id", "play_date", list(tables.PLAY_KEY), ["ship_name", "play_date"]
    )
    return (
        tables.members(spark, sf)
        .join(newest, "member_id", "left")
        .select(
            "member_id",
            "membership_tier",
            F.col("ship_name").alias("last_ship"),
            F.col("play_date").alias("last_date"),
        )
    )


@query(
    "win03_session_recency",
    PL
    + """SELECT play_order, play_part, play_machine, play_line, row_number() OVER (PARTITION BY member_id
    ORDER BY play_date DESC, play_order DESC, play_part DESC, play_machine DESC, play_line DESC) AS rn FROM plays""",
)
def session_recency(spark, sf):
    """Position of every session in its member's history, newest first.

    A member's rank is (sessions on later days) + (rank within the day): the day counts
    carry a member with very many sessions, so no task sorts a whole member.
    """

    plays = tables.plays(spark, sf, games=False).select("member_id", "play_date", *tables.PLAY_KEY)
    later = Window.partitionBy("member_id").orderBy(F.desc("play_date")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_day = (
        plays.groupBy("member_id", "play_date")
        .agg(F.count("*").alias("n"))
        .select("member_id", "play_date", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("member_id", "play_date").orderBy(*[F.desc(c) for c in tables.PLAY_KEY])
    return plays.join(per_day, ["member_id", "play_date"]).select(
        *tables.PLAY_KEY, (F.col("before") + F.row_number().over(within)).alias("rn")
    )


# --- daily mart ---------------------------------------------------------------------------

DAILY_CTE = f"""daily AS (SELECT ship_name, play_date, CAST(dayofweek(play_date) AS INTEGER) AS dow_sun0,
  CAST(month(play_date) AS INTEGER) AS month_num, count(*) AS sessions, count(DISTINCT member_id) AS unique_players,
  {rounded('CAST(sum(num_spins) AS DOUBLE) / count(*)', 1)} AS avg_spins,
  {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet_per_spin,
  CAST(sum(total_wagered) AS DOUBLE) AS daily_wagered, CAST(sum(total_won) AS DOUBLE) AS daily_won,
  {rounded('CAST(sum(total_won) AS DOUBLE) / nullif(CAST(sum(total_wagered) AS DOUBLE), 0) * 100', 2)} AS win_rate_pct,
  {rounded('CAST(sum(session_duration_mins) AS DOUBLE) / count(*)', 1)} AS avg_session_mins,
  count(*) FILTER (time_of_day = 'Night') AS night_sessions,
  count(*) FILTER (time_of_day = 'Evening') AS evening_sessions,
  count(*) FILTER (game_type = 'PROMO') AS progressive_sessions FROM plays GROUP BY ship_name, play_date)"""
DAILY = with_views("plays", more=DAILY_CTE)


def daily_mart(spark, sf, plays=None):
    return daily.daily_metrics(_plays(spark, sf, plays), tables.PROGRESSIVE_TYPE)


query("day01_daily_metrics", DAILY + "SELECT * FROM daily")(daily_mart)

DAY2_SQL = """SELECT *, CASE WHEN rn * 100 <= total * 80 THEN 'TRAIN' ELSE 'TEST' END AS split,
  CAST(ascii(right(ship_name, 1)) - 65 AS INTEGER) AS ship_encoded,
  CASE WHEN win_rate_pct IS NULL THEN NULL WHEN win_rate_pct < 80 THEN 'Very_Low' WHEN win_rate_pct < 85 THEN 'Low'
       WHEN win_rate_pct < 90 THEN 'Medium' WHEN win_rate_pct < 95 THEN 'High' ELSE 'Very_High' END AS win_rate_category
  FROM (SELECT *, row_number() OVER (ORDER BY play_date, ship_name) AS rn,
               CAST(count(*) OVER () AS BIGINT) AS total FROM daily)"""


@query("day02_win_rate_training", DAILY + DAY2_SQL)
def win_rate_training(spark, sf, plays=None):
    return daily.win_rate_training(daily_mart(spark, sf, plays))


@query(
    "flt05_win_rate_train_view",
    DAILY
    + f"SELECT {', '.join(daily.WIN_RATE_FEATURES)}, win_rate_category FROM ({DAY2_SQL}) WHERE split = 'TRAIN'",
)
def win_rate_view(spark, sf):
    return daily.win_rate_view(win_rate_training(spark, sf))


@query(
    "win04_chronological_split",
    DAILY
    + """SELECT split, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM (
    SELECT row_number() OVER (ORDER BY play_date, ship_name) AS rn,
           CASE WHEN row_number() OVER (ORDER BY play_date, ship_name) * 100 <= count(*) OVER () * 80
                THEN 'TRAIN' ELSE 'TEST' END AS split FROM daily) GROUP BY split""",
)
def chronological(spark, sf):
    ranked = split.chronological_split(daily_mart(spark, sf), "play_date", ["ship_name"])
    return ranked.groupBy("split").agg(
        F.count("*").alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn")
    )


@query(
    "flt07_tail_cut",
    DAILY
    + """SELECT ship_name, play_date FROM daily WHERE play_date <= (SELECT max(play_date) FROM daily) - 7""",
)
def tail_cut(spark, sf):
    days = tables.plays(spark, sf, games=False).select("ship_name", "play_date").distinct()
    # one row per ship and calendar day is left for the window
    last = F.max("play_date").over(Window.partitionBy())
    return days.withColumn("last", last).where(F.col("play_date") <= F.date_sub("last", 7)).drop("last")


# --- demand -------------------------------------------------------------------------------

WEIGHTS_CTE = "weights(ship_name, denomination, weight) AS (VALUES {})".format(
    ", ".join(
        f"('{ship}', CAST({denom} AS DECIMAL(10,2)), CAST({weight} AS DECIMAL(10,2)))"
        for ship, row in P.SHIP_WEIGHTS.items()
        for denom, weight in zip(P.DENOMINATIONS, row)
    )
)
CDF_CTE = (
    WEIGHTS_CTE
    + """, cdf AS (SELECT *, sum(weight) OVER (PARTITION BY ship_name ORDER BY denomination) AS high,
      sum(weight) OVER (PARTITION BY ship_name) AS total FROM weights),
    redrawn AS (SELECT p.*, (SELECT min(c.denomination) FROM cdf c WHERE c.ship_name = p.ship_name
      AND c.high >= p.u * c.total) AS new_denomination FROM plays p)"""
)


@query(
    "win01_ship_cdf",
    with_views("plays", more=WEIGHTS_CTE)
    + """, seen AS (SELECT ship_name, denomination, count(*) AS n FROM plays GROUP BY ALL)
    SELECT ship_name, CAST(denomination AS DOUBLE) AS denomination, n,
    CAST(sum(n) OVER (PARTITION BY ship_name ORDER BY denomination) AS DOUBLE)
      / CAST(sum(n) OVER (PARTITION BY ship_name) AS DOUBLE) AS cdf_upper FROM seen""",
)
def ship_cdf(spark, sf):
    """Empirical CDF of the denominations played on each ship."""
    seen = tables.plays(spark, sf, games=False).groupBy("ship_name", "denomination").agg(F.count("*").alias("n"))
    return cdf.cumulative_shares(seen, "ship_name", "denomination", "n").withColumn(
        "denomination", F.col("denomination").cast("double")
    )


def redistributed(spark, sf):
    return demand.redistribute(tables.plays(spark, sf, games=False), P.ship_weights(spark))


@query(
    "gen03_redistribute",
    with_views("plays", more=CDF_CTE)
    + """SELECT play_order, play_part, play_machine, play_line, ship_name, CAST(new_denomination AS DOUBLE) AS denomination,
    CAST(round(num_spins * CAST(bet_per_spin AS DECIMAL(8,2)) * CAST(new_denomination AS DECIMAL(8,2)), 2) AS DOUBLE) AS total_wagered,
    CAST(round(CAST(num_spins * CAST(bet_per_spin AS DECIMAL(8,2)) * CAST(new_denomination AS DECIMAL(8,2)) AS DECIMAL(24,4))
         * CAST(payout AS DECIMAL(6,4)), 2) AS DOUBLE) AS total_won FROM redrawn""",
)
def redistribute(spark, sf):
    return redistributed(spark, sf).select(
        *tables.PLAY_KEY,
        "ship_name",
        F.col("denomination").cast("double"),
        F.col("total_wagered").cast("double"),
        F.col("total_won").cast("double"),
    )


@query(
    "jon10_cdf_assign",
    with_views("plays", more=CDF_CTE)
    + """SELECT ship_name, CAST(new_denomination AS DOUBLE) AS denomination, count(*) AS sessions
      FROM redrawn GROUP BY ALL""",
)
def cdf_assign(spark, sf):
    assigned = cdf.assign_category_by_cdf(tables.plays(spark, sf, games=False), P.ship_weights(spark), "u")
    return assigned.groupBy("ship_name", F.col("denomination").cast("double").alias("denomination")).agg(
        F.count("*").alias("sessions")
    )


@query(
    "snk05_net_result",
    PL
    + """SELECT ship_name, count(*) AS sessions, CAST(sum(net_result) AS DOUBLE) AS net_result,
      CAST(sum(total_won) - sum(total_wagered) AS DOUBLE) AS won_less_wagered FROM plays GROUP BY ship_name""",
)
def net_result(spark, sf):
    return (
        tables.plays(spark, sf, games=False)
        .groupBy("ship_name")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("net_result").cast("double").alias("net_result"),
            (F.sum("total_won") - F.sum("total_wagered")).cast("double").alias("won_less_wagered"),
        )
    )


def _in(column, values):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"CAST(count(*) FILTER ({column} IN ({listed})) AS DOUBLE) / count(*)"


MIX_SQL = f"""{rounded('CAST(sum(age) AS DOUBLE) / count(*)', 1)} AS avg_passenger_age,
  {rounded(_in('gender', ('M',)), 3)} AS pct_male,
  {rounded(_in('membership_tier', P.HIGH_TIER), 3)} AS pct_high_tier,
  {rounded(_in('income_bracket', P.HIGH_INCOME), 3)} AS pct_high_income,
  {rounded(_in('risk_appetite', P.HIGH_RISK), 3)} AS pct_high_risk,
  {rounded('CAST(sum(total_cruises) AS DOUBLE) / count(*)', 1)} AS avg_cruises,
  {rounded('CAST(sum(CAST(lifetime_spend AS DECIMAL(18,4))) AS DOUBLE) / count(*)', 0)} AS avg_lifetime_spend"""

DEMAND_CTE = f"""ship_mix AS (SELECT ship_name, {MIX_SQL} FROM plays JOIN members USING (member_id) GROUP BY ship_name),
denom_stats AS (SELECT ship_name, denomination, count(*) AS session_count, sum(total_wagered) AS wagered,
  {rounded('CAST(sum(num_spins) AS DOUBLE) / count(*)', 0)} AS avg_spins,
  {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet,
  count(DISTINCT member_id) AS unique_players FROM plays GROUP BY ship_name, denomination),
ship_totals AS (SELECT ship_name, sum(session_count) AS n, sum(wagered) AS w FROM denom_stats GROUP BY ship_name),
demand AS (SELECT s.ship_name, CAST(s.denomination AS DOUBLE) AS denomination, s.session_count,
  {rounded('s.session_count * 100.0::DOUBLE / CAST(t.n AS DOUBLE)', 2)} AS demand_pct,
  CAST(s.wagered AS DOUBLE) AS total_wagered,
  {rounded('CAST(s.wagered * 100 AS DOUBLE) / CAST(t.w AS DOUBLE)', 2)} AS wagered_pct,
  s.avg_spins, s.avg_bet, s.unique_players, d.* EXCLUDE (ship_name)
  FROM denom_stats s JOIN ship_totals t USING (ship_name) JOIN ship_mix d USING (ship_name))"""
DEMAND = with_views("members", "plays", more=DEMAND_CTE)


def demand_mart(spark, sf):
    return demand.bank_demand(tables.plays(spark, sf, games=False), tables.members(spark, sf)).withColumn(
        "denomination", F.col("denomination").cast("double")
    )


query("dem01_bank_demand", DEMAND + "SELECT * FROM demand")(demand_mart)
query("src06_ordered_demand", DEMAND + "SELECT * FROM demand ORDER BY ship_name, denomination")(
    lambda spark, sf: demand_mart(spark, sf).orderBy("ship_name", "denomination")
)


@query(
    "agg15_demand_shares",
    DEMAND + "SELECT ship_name, denomination, session_count, demand_pct, wagered_pct FROM demand",
)
def demand_shares(spark, sf):
    from pyspark.sql.window import Window

    from spindrift.functions.numeric import ratio

    ship = Window.partitionBy("ship_name")
    stats = (
        tables.plays(spark, sf, games=False)
        .groupBy("ship_name", "denomination")
        .agg(F.count("*").alias("session_count"), F.sum("total_wagered").alias("w"))
    )
    share = lambda c: round_half_up(ratio(F.col(c) * 100, F.sum(c).over(ship)), 2)
    return stats.select(
        "ship_name",
        F.col("denomination").cast("double"),
        "session_count",
        share("session_count").alias("demand_pct"),
        share("w").alias("wagered_pct"),
    )


@query("agg16_ship_mix", DEMAND + "SELECT * FROM ship_mix")
def ship_mix(spark, sf):
    return demand.ship_mix(tables.plays(spark, sf, games=False), tables.members(spark, sf))


@query(
    "agg26_demand_pivot",
    DEMAND
    + "SELECT ship_name, "
    + ", ".join(
        f"max(demand_pct) FILTER (denomination = {float(d)}) AS {share_column(float(d))}"
        for d in P.DENOMINATIONS
    )
    + " FROM demand GROUP BY ship_name",
)
def demand_pivot(spark, sf):
    prices = [float(d) for d in P.DENOMINATIONS]
    wide = demand_mart(spark, sf).groupBy("ship_name").pivot("denomination", prices).agg(F.first("demand_pct"))
    return wide.select("ship_name", *[F.col(f"`{p}`").alias(share_column(p)) for p in prices])


@query(
    "agg27_ship_constants",
    DEMAND
    + """SELECT ship_name, avg_passenger_age, pct_high_tier, unique_players FROM (
      SELECT *, row_number() OVER (PARTITION BY ship_name ORDER BY denomination) AS rn FROM demand) WHERE rn = 1""",
)
def ship_constants(spark, sf):
    return pick.first(
        demand_mart(spark, sf),
        "ship_name",
        ["denomination"],
        ["avg_passenger_age", "pct_high_tier", "unique_players"],
    )


# --- evaluation of a given prediction table ---------------------------------------------
# The predictions come from a simple rule (the denomination of the member's newest session),
# so that the evaluation itself can be checked by SQL on the whole tables.

RULE_CTE = (
    ENCODED_CTE
    + """, newest AS (SELECT member_id, CAST(denomination AS DOUBLE) AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY member_id
    ORDER BY play_date DESC, play_order DESC, play_part DESC, play_machine DESC, play_line DESC) AS rn FROM plays)
  WHERE rn = 1),
predictions AS (SELECT e.*, n.predicted FROM encoded e JOIN newest n USING (member_id) WHERE split = 'TEST'),
train AS (SELECT * FROM encoded WHERE split = 'TRAIN'),
majority AS (SELECT preferred_denomination AS v FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
)
RULE = with_views("members", "plays", more=RULE_CTE)


def rule_predictions(spark, sf):
    """(encoded table, test predictions as struct(class, probability))."""
    table = encoded(spark, sf)
    newest = pick.latest(
        tables.plays(spark, sf, games=False), "member_id", "play_date", list(tables.PLAY_KEY), ["denomination"]
    )
    prediction = F.struct(
        F.col("denomination").cast("double").alias("class"), F.lit(1.0).alias("probability")
    )
    predicted = table.where("split = 'TEST'").join(
        newest.select("member_id", prediction.alias("prediction")), "member_id"
    )
    return table, predicted


def _counts(predicted):
    return evaluation.confusion(predicted, "preferred_denomination", "prediction.class")


@query(
    "agg22_accuracy",
    RULE
    + f"""SELECT count(*) AS total, count(*) FILTER (predicted = preferred_denomination) AS correct,
      {rounded('count(*) FILTER (predicted = preferred_denomination) * 100.0::DOUBLE / count(*)', 2)} AS accuracy_pct
      FROM predictions""",
)
def accuracy(spark, sf):
    return evaluation.accuracy(_counts(rule_predictions(spark, sf)[1]))


@query(
    "agg23_majority_baseline",
    RULE
    + f"""SELECT count(*) AS test_size,
      count(*) FILTER (preferred_denomination = (SELECT v FROM majority)) AS baseline_correct,
      {rounded('count(*) FILTER (preferred_denomination = (SELECT v FROM majority)) * 100.0::DOUBLE / count(*)', 2)}
        AS baseline_accuracy_pct FROM predictions""",
)
def majority_baseline(spark, sf):
    table, predicted = rule_predictions(spark, sf)
    return evaluation.majority_baseline(table.where("split = 'TRAIN'"), predicted, "preferred_denomination")


@query(
    "agg24_confusion_counts",
    RULE
    + """SELECT CAST(preferred_denomination AS VARCHAR) AS actual, CAST(predicted AS VARCHAR) AS predicted,
      count(*) AS n FROM predictions GROUP BY 1, 2""",
)
def confusion_counts(spark, sf):
    return _counts(rule_predictions(spark, sf)[1])


_CLASSES = [str(float(d)) for d in P.DENOMINATIONS]


@query(
    "agg25_confusion_matrix",
    RULE
    + "SELECT CAST(preferred_denomination AS VARCHAR) AS actual, "
    + ", ".join(f'count(*) FILTER (predicted = {c}) AS "{share_column(float(c))}"' for c in _CLASSES)
    + " FROM predictions GROUP BY 1",
)
def confusion_matrix(spark, sf):
    wide = evaluation.confusion_wide(_counts(rule_predictions(spark, sf)[1]), _CLASSES)
    return wide.select("actual", *[F.col(f"`{c}`").alias(share_column(float(c))) for c in _CLASSES])


@query(
    "agg31_evaluation_summary",
    RULE
    + f"""SELECT 'Newest-session rule' AS model_name, 'Classification' AS model_type,
      'preferred_denomination' AS target, test_size, model_accuracy_pct, baseline_accuracy_pct,
      'Most frequent class of the training split' AS baseline_method, 'rule, not trained' AS notes,
      {rounded('model_accuracy_pct - baseline_accuracy_pct', 2)} AS improvement_pp FROM (
      SELECT count(*) AS test_size,
      {rounded('count(*) FILTER (predicted = preferred_denomination) * 100.0::DOUBLE / count(*)', 2)} AS model_accuracy_pct,
      {rounded('count(*) FILTER (preferred_denomination = (SELECT v FROM majority)) * 100.0::DOUBLE / count(*)', 2)}
        AS baseline_accuracy_pct FROM predictions)""",
)
def evaluation_summary(spark, sf):
    table, predicted = rule_predictions(spark, sf)
    base = evaluation.majority_baseline(table.where("split = 'TRAIN'"), predicted, "preferred_denomination")
    return evaluation.summary_row(
        _counts(predicted), base, "Newest-session rule", "preferred_denomination", "rule, not trained"
    )


@query(
    "ml13_class_report",
    RULE
    + f""", labels_seen AS (SELECT DISTINCT preferred_denomination AS c FROM predictions
      UNION SELECT DISTINCT predicted FROM predictions),
    cells AS (SELECT c, (SELECT count(*) FROM predictions WHERE preferred_denomination = c) AS support,
      (SELECT count(*) FROM predictions WHERE predicted = c) AS answered,
      (SELECT count(*) FROM predictions WHERE predicted = c AND preferred_denomination = c) AS hits FROM labels_seen)
    SELECT CAST(c AS VARCHAR) AS label, support,
      {rounded('coalesce(hits::DOUBLE / nullif(answered::DOUBLE, 0), 0)', 6)} AS precision,
      {rounded('coalesce(hits::DOUBLE / nullif(support::DOUBLE, 0), 0)', 6)} AS recall,
      {rounded('coalesce(2 * hits::DOUBLE / nullif((support + answered)::DOUBLE, 0), 0)', 6)} AS f1 FROM cells""",
)
def class_report(spark, sf):
    return evaluation.class_report(_counts(rule_predictions(spark, sf)[1]))


@query(
    "ml13_weighted_f1",
    RULE
    + f""", labels_seen AS (SELECT DISTINCT preferred_denomination AS c FROM predictions),
    cells AS (SELECT c, (SELECT count(*) FROM predictions WHERE preferred_denomination = c) AS support,
      (SELECT count(*) FROM predictions WHERE predicted = c) AS answered,
      (SELECT count(*) FROM predictions WHERE predicted = c AND preferred_denomination = c) AS hits FROM labels_seen),
    f AS (SELECT support, {rounded('coalesce(2 * hits::DOUBLE / nullif((support + answered)::DOUBLE, 0), 0)', 6)} AS f1 FROM cells)
    SELECT {rounded('CAST(sum(CAST(f1 * support AS DECIMAL(28,6))) AS DOUBLE) / sum(support)', 6)} AS weighted_f1 FROM f""",
)
def weighted_f1(spark, sf):
    return evaluation.weighted_f1(_counts(rule_predictions(spark, sf)[1]))


@query(
    "ml13_regression_metrics",
    FEATURES
    + f""", p AS (SELECT membership_tier, avg_bet_per_spin AS y, total_sessions * 0.1::DOUBLE AS yhat FROM features)
    SELECT membership_tier, count(*) AS n,
      {rounded('CAST(sum(CAST(abs(y - yhat) AS DECIMAL(28,12))) AS DOUBLE) / count(*)', 6)} AS mae,
      {rounded('sqrt(avg((y - yhat) * (y - yhat)))', 6)} AS rmse,
      {rounded('1 - avg((y - yhat) * (y - yhat)) / nullif(var_pop(y), 0)', 6)} AS r2
    FROM p GROUP BY membership_tier""",
)
def regression_metrics(spark, sf):
    rows = member_features(spark, sf).select(
        "membership_tier",
        F.col("avg_bet_per_spin").alias("y"),
        (F.col("total_sessions") * F.lit(0.1)).alias("yhat"),
    )
    return evaluation.regression_metrics(rows, "y", "yhat", by=("membership_tier",))


@query(
    "scl02_bins",
    DAILY
    + """SELECT CASE WHEN win_rate_pct < 80 THEN 'Very_Low' WHEN win_rate_pct < 85 THEN 'Low'
       WHEN win_rate_pct < 90 THEN 'Medium' WHEN win_rate_pct < 95 THEN 'High' ELSE 'Very_High' END AS win_rate_category,
       CASE WHEN avg_bet_per_spin <= 2 THEN 'Low' WHEN avg_bet_per_spin <= 4 THEN 'Medium'
       WHEN avg_bet_per_spin <= 7 THEN 'High' ELSE 'VeryHigh' END AS bet_category, count(*) AS ship_days
       FROM daily WHERE win_rate_pct IS NOT NULL GROUP BY 1, 2""",
)
def binned(spark, sf):
    return (
        daily_mart(spark, sf)
        .where("win_rate_pct is not null")
        .groupBy(
            encode.win_rate_category(F.col("win_rate_pct")).alias("win_rate_category"),
            encode.bet_category(F.col("avg_bet_per_spin")).alias("bet_category"),
        )
        .agg(F.count("*").alias("ship_days"))
    )


@query(
    "scl10_calendar",
    PL
    + """SELECT play_date, CAST(month(play_date) AS INTEGER) AS play_month, CAST(dayofweek(play_date) AS INTEGER) AS dow_sun0,
      CAST((dayofweek(play_date) + 6) % 7 AS INTEGER) AS dow_mon0,
      CASE WHEN dayofweek(play_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, count(*) AS sessions
      FROM plays GROUP BY ALL""",
)
def calendar_columns(spark, sf):
    per_day = tables.plays(spark, sf, games=False).groupBy("play_date").agg(F.count("*").alias("sessions"))
    return calendar.with_calendar(per_day, "play_date").withColumn(
        "dow_sun0", calendar.dow_sun0(F.col("play_date"))
    )


@query(
    "scl13_seeded_uniform",
    M
    + """SELECT member_id, CAST(CAST('0x' || substr(md5('demo:' || CAST(member_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE)
      / 4294967296.0 AS u FROM members""",
)
def seeded_uniform(spark, sf):
    return tables.members(spark, sf).select("member_id", uniform("member_id", salt="demo").alias("u"))


@query(
    "scl16_clip",
    M
    + """SELECT member_id, CASE WHEN member_id % 7 = 0 THEN NULL WHEN lifetime_spend < -500 THEN -500.0::DOUBLE
      WHEN lifetime_spend > 5000 THEN 5000.0::DOUBLE ELSE lifetime_spend END AS clipped FROM members""",
)
def clipped(spark, sf):
    """Every seventh member has no amount, which must stay so."""
    amount = F.when(F.col("member_id") % 7 != 0, F.col("lifetime_spend"))
    return tables.members(spark, sf).select("member_id", clip(amount, -500.0, 5000.0).alias("clipped"))


@query(
    "scl22_json_probability",
    """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0) AS p_k,
       coalesce(CAST(json_extract(props, '$.missing') AS DOUBLE), 0) AS p_missing FROM events""",
)
def json_probability(spark, sf):
    """Probability map kept as JSON text; a class that is not listed has probability 0."""
    parsed = F.from_json("props", "map<string,double>")
    zero = F.lit(0.0)
    return tables.read(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.try_element_at(parsed, F.lit("k")), zero).alias("p_k"),
        F.coalesce(F.try_element_at(parsed, F.lit("missing")), zero).alias("p_missing"),
    )


@query(
    "ml04_stratified_split",
    PL
    + """SELECT CAST(denomination AS DOUBLE) AS denomination, floor(count(*) * 80 / 100)::BIGINT AS train_rows,
      count(*) - floor(count(*) * 80 / 100)::BIGINT AS test_rows FROM plays GROUP BY 1""",
)
def stratified(spark, sf):
    rows = tables.plays(spark, sf, games=False).select("denomination", *tables.PLAY_KEY)
    marked = split.stratified_split(rows, "denomination", list(tables.PLAY_KEY))
    return marked.groupBy(F.col("denomination").cast("double").alias("denomination")).agg(
        F.count_if(F.col("split") == "TRAIN").alias("train_rows"),
        F.count_if(F.col("split") == "TEST").alias("test_rows"),
    )
