"""Metric-layer requests and named reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.numeric import round_half_up
from spindrift.plans import semantic
from spindrift.registry.base import query, rounded, with_views
from spindrift.registry.marts import FEATURES, member_features
from spindrift.sources import schemas, tables

M = with_views("members")
PL = with_views("plays")
MP = with_views("members", "plays")


class Frames(dict):
    """Logical tables, each built only when a request touches it."""

    def __init__(self, spark, sf):
        self._build = {
            "members": lambda: tables.members(spark, sf),
            "plays": lambda: tables.plays(spark, sf),
            "features": lambda: member_features(spark, sf),
        }

    def __missing__(self, name):
        self[name] = self._build[name]()
        return self[name]


def ask(spark, sf, **request):
    return semantic.compile_request(semantic.MODEL, Frames(spark, sf), **request)


@query(
    "sem01_dimensions",
    MP
    + """SELECT m.membership_tier, p.ship_name, count(*) AS total_sessions FROM plays p
      LEFT JOIN members m USING (member_id) GROUP BY ALL""",
)
def dimensions(spark, sf):
    return ask(spark, sf, metrics=["total_sessions"], dimensions=["tier", "ship"])


@query(
    "sem02_member_metrics",
    M
    + """SELECT membership_tier, count(*) AS total_members, CAST(sum(age) AS DOUBLE) / count(*) AS avg_age,
      CAST(sum(CAST(lifetime_spend AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS avg_lifetime_spend FROM members GROUP BY 1""",
)
def member_metrics(spark, sf):
    return ask(
        spark, sf, metrics=["total_members", "avg_age", "avg_lifetime_spend"], dimensions=["membership_tier"]
    )


PLAY_METRICS = """count(*) AS total_sessions, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered,
  CAST(sum(total_won) AS DOUBLE) AS total_amount_won, CAST(sum(bet_per_spin) AS DOUBLE) / count(*) AS avg_bet,
  CAST(sum(num_spins) AS DOUBLE) AS total_spins, count(DISTINCT member_id) AS unique_players,
  CAST(sum(session_duration_mins) AS DOUBLE) / count(*) AS avg_session_duration"""
_PLAY_NAMES = [
    "total_sessions",
    "total_amount_wagered",
    "total_amount_won",
    "avg_bet",
    "total_spins",
    "unique_players",
    "avg_session_duration",
]


@query("sem03_play_metrics", PL + f"SELECT ship_name, {PLAY_METRICS} FROM plays GROUP BY ship_name")
def play_metrics(spark, sf):
    return ask(spark, sf, metrics=_PLAY_NAMES, dimensions=["vessel"])


@query(
    "sem03_play_metrics_by_member_attributes",
    MP
    + f"""SELECT home_state, {PLAY_METRICS} FROM plays LEFT JOIN members USING (member_id) GROUP BY home_state""",
)
def play_metrics_by_state(spark, sf):
    return ask(spark, sf, metrics=_PLAY_NAMES, dimensions=["members.home_state"])


@query(
    "sem04_feature_metrics",
    FEATURES
    + f"""SELECT preferred_game_type, count(*) AS member_count,
      {rounded('CAST(sum(CAST(total_wagered AS DECIMAL(28,4))) AS DOUBLE) / count(total_wagered)', 8)} AS avg_member_wagered,
      {rounded('avg(win_rate_pct)', 8)} AS avg_win_rate
      FROM features GROUP BY 1""",
)
def feature_metrics(spark, sf):
    rows = ask(
        spark,
        sf,
        metrics=["member_count", "avg_member_wagered", "avg_win_rate"],
        dimensions=["preferred_game_type"],
    )
    return rows.withColumns({c: round_half_up(F.col(c), 8) for c in ("avg_member_wagered", "avg_win_rate")})


@query(
    "flt08_named_filters",
    PL
    + """SELECT ship_name, count(*) AS total_sessions, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered
      FROM plays WHERE denomination >= 5 GROUP BY 1""",
)
def named_filter(spark, sf):
    return ask(
        spark,
        sf,
        metrics=["total_sessions", "total revenue"],
        dimensions=["ship"],
        filters=["high_denomination"],
    )


@query(
    "flt08_penny_slots",
    MP
    + """SELECT game_name, count(*) AS total_sessions FROM plays JOIN members USING (member_id)
      WHERE denomination = 0.01 AND membership_tier IN ('Gold', 'Platinum') GROUP BY 1""",
)
def penny_slots(spark, sf):
    return ask(
        spark,
        sf,
        metrics=["session count"],
        dimensions=["game"],
        filters=["penny_slots", ("tier", ["Gold", "Platinum"])],
    )


@query(
    "sem07_two_tables",
    MP
    + """SELECT membership_tier, max(total_members) AS total_members, max(avg_age) AS avg_age,
      max(total_sessions) AS total_sessions, max(unique_players) AS unique_players FROM (
      SELECT membership_tier, count(*) AS total_members, CAST(sum(age) AS DOUBLE) / count(*) AS avg_age,
             NULL::BIGINT AS total_sessions, NULL::BIGINT AS unique_players FROM members GROUP BY 1
      UNION ALL SELECT membership_tier, NULL, NULL, count(*), count(DISTINCT member_id)
      FROM plays LEFT JOIN members USING (member_id) GROUP BY 1) GROUP BY 1""",
)
def two_tables(spark, sf):
    return ask(
        spark,
        sf,
        metrics=["total_members", "avg_age", "total_sessions", "unique_players"],
        dimensions=["members.membership_tier"],
    )


@query(
    "jon14_auto_join",
    MP
    + """SELECT income_bracket, CAST(date_trunc('year', play_date) AS DATE) AS play_date,
      CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered FROM plays LEFT JOIN members USING (member_id) GROUP BY ALL""",
)
def auto_join(spark, sf):
    return ask(spark, sf, metrics=["total revenue"], dimensions=["income", "session date"], grain="year")


@query(
    "sem06_enum_check",
    M
    + """SELECT 'membership_tier' AS column_name, membership_tier AS value, count(*) AS n_rows FROM members
      WHERE membership_tier NOT IN ('Basic', 'Bronze', 'Silver') GROUP BY ALL""",
)
def enum_check(spark, sf):
    """Rows outside a (deliberately narrowed) value list."""
    return schemas.unlisted_values(
        tables.members(spark, sf), {"membership_tier": ("Basic", "Bronze", "Silver"), "gender": ("M", "F")}
    )


_GAME_TYPE_SQL = (
    FEATURES
    + """SELECT preferred_game_type, count(*) AS total_sessions, CAST(sum(p.total_wagered) AS DOUBLE) AS total_amount_wagered,
      count(DISTINCT p.member_id) AS unique_players
      FROM plays p LEFT JOIN features f ON f.member_id = p.member_id GROUP BY 1"""
)


@query("sem07_sessions_by_preferred_game_type", _GAME_TYPE_SQL)
def sessions_by_preferred_game_type(spark, sf):
    """Two relationships away: sessions to members, members to their features."""
    return ask(spark, sf, metrics=["plays.total_sessions", "total revenue", "unique_players"], dimensions=["preferred_game_type"])


@query(
    "jon14_two_relationships",
    FEATURES
    + """SELECT m.home_state, f.most_played_ship, count(*) AS total_sessions FROM plays p
      JOIN members m ON m.member_id = p.member_id JOIN features f ON f.member_id = p.member_id
      WHERE m.membership_tier IN ('Gold', 'Platinum') GROUP BY ALL""",
)
def two_relationships(spark, sf):
    """Dimensions one and two relationships away, with a filter in between."""
    return ask(
        spark, sf, metrics=["plays.total_sessions"], dimensions=["members.home_state", "most_played_ship"], filters=[("tier", ["Gold", "Platinum"])]
    )


def _checks_sql(table: str, view: str) -> str:
    known = semantic.MODEL.tables[table]
    lines = []
    for d in {d.expr: d for d in known.dimensions.values()}.values():
        lines.append((d.expr, "present", f"count(*) FILTER ({d.expr} IS NULL)"))
        if d.values:
            lines.append((d.expr, "listed", f"count(*) FILTER (CAST({d.expr} AS VARCHAR) NOT IN ({', '.join(repr(v) for v in d.values)}))"))
        if d.unique:
            lines.append((d.expr, "unique", f"count({d.expr}) - count(DISTINCT {d.expr})"))
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{k}' AS \"check\", {e} AS n_rows FROM {view}" for c, k, e in lines)


@query("sem06_data_checks", FEATURES + " UNION ALL ".join(_checks_sql(t, t) for t in ("members", "plays", "features")))
def data_checks(spark, sf):
    """Every declared list, column and unique key, one pass a table."""
    frames = Frames(spark, sf)
    checks = [semantic.data_checks(semantic.MODEL, frames, t) for t in ("members", "plays", "features")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


_REPORT_SQL = {
    "total_members_by_tier": M + "SELECT membership_tier, count(*) AS total_members FROM members GROUP BY 1",
    "member_count_by_tier": M + "SELECT membership_tier, count(*) AS total_members FROM members GROUP BY 1",
    "top_games_by_revenue": PL
    + """SELECT game_name, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered FROM plays
      GROUP BY 1 ORDER BY sum(total_wagered) DESC, game_name LIMIT 5""",
    "avg_bet_by_denomination": PL
    + f"""SELECT CAST(denomination AS DOUBLE) AS denomination,
      {rounded('CAST(sum(bet_per_spin) AS DOUBLE) / count(*)', 2)} AS avg_bet FROM plays GROUP BY denomination""",
    "ship_revenue_comparison": PL
    + "SELECT ship_name, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered FROM plays GROUP BY 1",
    "total_revenue_by_ship": PL
    + "SELECT ship_name, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered FROM plays GROUP BY 1",
    "monthly_revenue_trend": PL
    + """SELECT CAST(date_trunc('month', play_date) AS DATE) AS play_date, CAST(sum(total_wagered) AS DOUBLE) AS total_amount_wagered,
      count(DISTINCT member_id) AS unique_players FROM plays GROUP BY 1""",
    "top_games_by_sessions": PL
    + "SELECT game_name, count(*) AS total_sessions FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "high_value_members": FEATURES
    + """SELECT member_id, total_wagered, total_won, win_rate_pct, membership_tier, preferred_denomination
      FROM features ORDER BY total_wagered DESC, member_id LIMIT 10""",
}


def _register_report(name, sql):
    number = "09" if name in ("total_revenue_by_ship", "member_count_by_tier", "top_games_by_sessions") else "08"

    @query(f"sem{number}_{name}", sql)
    def build(spark, sf):
        result = semantic.report(name, Frames(spark, sf))
        if "denomination" in result.columns:
            result = result.withColumn("denomination", F.col("denomination").cast("double"))
        return result


for _name, _sql in _REPORT_SQL.items():
    _register_report(_name, _sql)
