"""Rolling voyages, profit forecasts and floor plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.numeric import ratio, round_half_up
from spindrift.operators.allocate import allocate
from spindrift.plans import demand, floor, mix, voyage
from spindrift.registry.base import query, rounded, with_views
from spindrift.registry.marts import DEMAND_CTE, demand_mart
from spindrift.sources import parameters as P
from spindrift.sources import tables, workdir


def _listed(values):
    return ", ".join(f"'{v}'" for v in values)


def voyage_cte(groups: mix.Groups) -> str:
    def per_player(condition):
        return (
            f"CAST(count(*) FILTER ({condition}) AS DOUBLE) / nullif(CAST(count(DISTINCT member_id) AS DOUBLE), 0)"
        )

    return f"""
ship_day AS (SELECT ship_name, play_date, count(*) AS sessions, count(DISTINCT member_id) AS players,
  sum(total_wagered) AS wagered, sum(total_won) AS won FROM plays GROUP BY ship_name, play_date),
windows AS (SELECT ship_name, play_date AS departure_date, CAST(d AS INTEGER) AS voyage_duration
  FROM ship_day CROSS JOIN (SELECT unnest([3, 4, 5, 6, 7]) AS d)
  WHERE play_date <= (SELECT max(play_date) FROM ship_day) - 7),
voyage_money AS (SELECT w.ship_name, departure_date, voyage_duration, sum(wagered) AS wagered, sum(won) AS won,
  CAST(sum(sessions) AS DOUBLE) / count(*) AS avg_daily_sessions, CAST(sum(players) AS DOUBLE) / count(*) AS avg_daily_players
  FROM windows w JOIN ship_day s ON s.ship_name = w.ship_name AND s.play_date >= departure_date
   AND s.play_date < departure_date + voyage_duration GROUP BY ALL),
voyage_mix AS (SELECT w.ship_name, departure_date, voyage_duration, count(DISTINCT member_id) AS distinct_players,
  CAST(sum(age) AS DOUBLE) / count(*) AS avg_passenger_age,
  {per_player("gender = 'M'")} AS ratio_male_per_player,
  {per_player(f"membership_tier IN ({_listed(groups.tiers)})")} AS ratio_high_tier_per_player,
  {per_player(f"income_bracket IN ({_listed(groups.incomes)})")} AS ratio_high_income_per_player,
  {per_player(f"risk_appetite IN ({_listed(groups.risks)})")} AS ratio_high_risk_per_player,
  CAST(sum(total_cruises) AS DOUBLE) / count(*) AS avg_cruises,
  CAST(sum(CAST(lifetime_spend AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_lifetime_spend
  FROM windows w JOIN plays p ON p.ship_name = w.ship_name AND p.play_date >= departure_date
   AND p.play_date < departure_date + voyage_duration JOIN members m USING (member_id) GROUP BY ALL),
training AS (SELECT m.ship_name, m.departure_date, m.voyage_duration, CAST(month(m.departure_date) AS INTEGER) AS departure_month,
  CAST(dayofweek(m.departure_date) AS INTEGER) AS departure_dow_sun0, CAST(wagered AS DOUBLE) AS total_wagered,
  CAST(won AS DOUBLE) AS total_won, CAST(wagered - won AS DOUBLE) AS total_profit, avg_daily_sessions, avg_daily_players,
  coalesce(avg_passenger_age, 50) AS avg_passenger_age, coalesce(ratio_male_per_player, 0.5) AS ratio_male_per_player,
  coalesce(ratio_high_tier_per_player, 0.2) AS ratio_high_tier_per_player,
  coalesce(ratio_high_income_per_player, 0.2) AS ratio_high_income_per_player,
  coalesce(ratio_high_risk_per_player, 0.3) AS ratio_high_risk_per_player, coalesce(avg_cruises, 10) AS avg_cruises,
  coalesce(avg_lifetime_spend, 20000) AS avg_lifetime_spend
  FROM voyage_money m LEFT JOIN voyage_mix d USING (ship_name, departure_date, voyage_duration))"""


NARROW = with_views("members", "plays", more=voyage_cte(mix.VOYAGE_GROUPS))
BROAD_CTE = voyage_cte(mix.Groups())
BROAD = with_views("members", "plays", more=BROAD_CTE)


def training(spark, sf, groups=mix.VOYAGE_GROUPS):
    return voyage.training(tables.plays(spark, sf), tables.members(spark, sf), groups)


def broad_training(spark, sf):
    return training(spark, sf, mix.Groups())


query("voy03_training", NARROW + "SELECT * FROM training")(training)


@query(
    "voy01_rolling_money",
    NARROW
    + """SELECT ship_name, departure_date, voyage_duration, CAST(wagered AS DOUBLE) AS total_wagered,
      CAST(won AS DOUBLE) AS total_won, CAST(wagered - won AS DOUBLE) AS total_profit, avg_daily_sessions,
      avg_daily_players FROM voyage_money""",
)
def rolling_money(spark, sf):
    return training(spark, sf).select(
        "ship_name",
        "departure_date",
        "voyage_duration",
        "total_wagered",
        "total_won",
        "total_profit",
        "avg_daily_sessions",
        "avg_daily_players",
    )


@query(
    "voy02_rolling_mix",
    BROAD
    + """SELECT ship_name, departure_date, voyage_duration, distinct_players, avg_passenger_age, ratio_male_per_player,
      ratio_high_tier_per_player, ratio_high_income_per_player, ratio_high_risk_per_player FROM voyage_mix""",
)
def rolling_mix(spark, sf):
    days = voyage.stored_voyage_days(tables.plays(spark, sf), tables.members(spark, sf), mix.Groups())
    voyages = voyage.rolling_voyages(days)
    n, players = F.col("mix_sessions"), F.col("distinct_players")
    return voyages.where("mix_sessions > 0").select(
        "ship_name",
        "departure_date",
        "voyage_duration",
        "distinct_players",
        ratio(F.col("mix_age"), n).alias("avg_passenger_age"),
        ratio(F.col("mix_male"), players).alias("ratio_male_per_player"),
        ratio(F.col("mix_high_tier"), players).alias("ratio_high_tier_per_player"),
        ratio(F.col("mix_high_income"), players).alias("ratio_high_income_per_player"),
        ratio(F.col("mix_high_risk"), players).alias("ratio_high_risk_per_player"),
    )


@query(
    "jon08_day_expansion",
    NARROW
    + """SELECT ship_name, departure_date, voyage_duration, CAST(wagered AS DOUBLE) AS total_wagered FROM voyage_money""",
)
def day_expansion(spark, sf):
    """The range join as an equi-join: every voyage is expanded to its days.

    Runs on ship days only, so the expansion is bounded by the calendar.
    """
    days = (
        tables.plays(spark, sf, games=False)
        .groupBy("ship_name", "play_date")
        .agg(F.sum("total_wagered").alias("wagered"))
    )
    last = days.agg(F.date_sub(F.max("play_date"), P.TAIL_DAYS).alias("last"))
    voyages = (
        days.where(F.col("play_date") <= last.scalar())
        .select("ship_name", F.col("play_date").alias("departure_date"))
        .withColumn("voyage_duration", F.explode(F.sequence(F.lit(3), F.lit(7))))
        .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("voyage_duration") - 1)))
        .withColumn("play_date", F.date_add("departure_date", F.col("offset")))
    )
    return (
        voyages.join(days, ["ship_name", "play_date"])
        .groupBy("ship_name", "departure_date", "voyage_duration")
        .agg(F.sum("wagered").cast("double").alias("total_wagered"))
    )


@query(
    "jon07_departures_by_duration",
    NARROW + "SELECT ship_name, departure_date, voyage_duration FROM windows",
)
def departures(spark, sf):
    days = tables.plays(spark, sf, games=False).select("ship_name", "play_date").distinct()
    last = days.agg(F.date_sub(F.max("play_date"), P.TAIL_DAYS).alias("last"))
    return days.where(F.col("play_date") <= last.scalar()).select(
        "ship_name",
        F.col("play_date").alias("departure_date"),
        F.explode(F.sequence(F.lit(3), F.lit(7))).alias("voyage_duration"),
    )


MEANS_SQL = """CAST(sum(CAST(total_profit AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_profit,
  CAST(sum(CAST(total_wagered AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_wagered,
  CAST(sum(CAST(total_won AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_won,
  CAST(sum(CAST(total_profit AS DECIMAL(20,2))) AS DOUBLE) / (count(*) * max(voyage_duration)) AS avg_daily_profit,
  count(*) AS match_count"""


@query(
    "agg19_history_by_month",
    NARROW
    + f"SELECT ship_name, voyage_duration, departure_month, {MEANS_SQL} FROM training GROUP BY ALL",
)
def history_by_month(spark, sf):
    return voyage.historical_averages(training(spark, sf), by_month=True)


@query(
    "agg19_history_all_months",
    NARROW + f"SELECT ship_name, voyage_duration, {MEANS_SQL} FROM training GROUP BY ALL",
)
def history_all_months(spark, sf):
    return voyage.historical_averages(training(spark, sf), by_month=False)


@query(
    "flt02_one_voyage_filter",
    NARROW
    + f"""SELECT ship_name, voyage_duration, departure_month, {MEANS_SQL} FROM training
      WHERE ship_name = 'Ship D' AND voyage_duration = 5 AND departure_month = 4 GROUP BY ALL""",
)
def one_voyage_filter(spark, sf):
    chosen = training(spark, sf).where(
        (F.col("ship_name") == "Ship D") & (F.col("voyage_duration") == 5) & (F.col("departure_month") == 4)
    )
    return voyage.historical_averages(chosen, by_month=True)


_HIST = ", ".join(
    f"{rounded(f'CAST(sum(CAST({c} AS DECIMAL(28,12))) AS DOUBLE) / count(*)', 8)} AS {h}"
    for h, c in (
        ("hist_high_tier", "ratio_high_tier_per_player"),
        ("hist_high_risk", "ratio_high_risk_per_player"),
        ("hist_high_income", "ratio_high_income_per_player"),
        ("hist_age", "avg_passenger_age"),
    )
)


@query(
    "agg20_history_mix",
    BROAD + f"SELECT ship_name, voyage_duration, {_HIST} FROM training GROUP BY ALL",
)
def history_mix(spark, sf):
    hist = voyage.historical_mix(broad_training(spark, sf))
    names = [c for c in hist.columns if c.startswith("hist_")]
    return hist.withColumns({c: round_half_up(F.col(c), 8) for c in names})


@query(
    "agg21_profit_by_ship",
    NARROW
    + """SELECT ship_name, voyage_duration, CAST(sum(CAST(total_profit AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS avg_profit
      FROM training GROUP BY ALL""",
)
def profit_by_ship(spark, sf):
    return voyage.average_profit_by_ship(training(spark, sf))


# --- forecasts: every past voyage is asked again 364 days later, with its own mix ---------

REQUEST_CTE = """, requests AS (SELECT ship_name || ':' || strftime(departure_date, '%Y-%m-%d') || ':' || voyage_duration AS request_id,
  ship_name, departure_date + 364 AS departure_date, voyage_duration, avg_passenger_age AS avg_age,
  least(ratio_high_tier_per_player, 1.0::DOUBLE) AS pct_high_tier, least(ratio_high_risk_per_player, 1.0::DOUBLE) AS pct_high_risk,
  least(ratio_high_income_per_player, 1.0::DOUBLE) AS pct_high_income FROM training),
exact AS (SELECT ship_name, voyage_duration, departure_month, """ + MEANS_SQL + """ FROM training GROUP BY ALL),
wide AS (SELECT ship_name, voyage_duration, """ + MEANS_SQL + """ FROM training GROUP BY ALL),
hist AS (SELECT ship_name, voyage_duration,
  CAST(sum(CAST(ratio_high_tier_per_player AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS ht,
  CAST(sum(CAST(ratio_high_risk_per_player AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS hr,
  CAST(sum(CAST(ratio_high_income_per_player AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS hi,
  CAST(sum(CAST(avg_passenger_age AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS ha FROM training GROUP BY ALL),
factors AS (SELECT r.*, coalesce(e.match_count, w.match_count) AS match_count, e.match_count IS NOT NULL AS same_month,
  coalesce(e.avg_profit, w.avg_profit) AS bp, coalesce(e.avg_wagered, w.avg_wagered) AS bw,
  coalesce(e.avg_won, w.avg_won) AS bn, coalesce(e.avg_daily_profit, w.avg_daily_profit) AS bd,
  greatest(0.5::DOUBLE, least(2.0::DOUBLE,
   (CASE WHEN ht > 0 THEN 1 + 0.3::DOUBLE * (pct_high_tier - ht) / greatest(ht, 0.01::DOUBLE) ELSE 1 END)
   * (CASE WHEN hr > 0 THEN 1 + 0.2::DOUBLE * (pct_high_risk - hr) / greatest(hr, 0.01::DOUBLE) ELSE 1 END)
   * (CASE WHEN hi > 0 THEN 1 + 0.25::DOUBLE * (pct_high_income - hi) / greatest(hi, 0.01::DOUBLE) ELSE 1 END)
   * (CASE WHEN ha > 0 THEN 1 + 0.1::DOUBLE * (avg_age - ha) / ha ELSE 1 END))) AS f
  FROM requests r LEFT JOIN exact e ON e.ship_name = r.ship_name AND e.voyage_duration = r.voyage_duration
   AND e.departure_month = month(r.departure_date)
  LEFT JOIN wide w ON w.ship_name = r.ship_name AND w.voyage_duration = r.voyage_duration
  LEFT JOIN hist h ON h.ship_name = r.ship_name AND h.voyage_duration = r.voyage_duration),
forecasts AS (SELECT request_id, ship_name, departure_date, voyage_duration, match_count, same_month, f AS demo_factor,
  bp * f AS predicted_profit, bw * f AS predicted_wagered, bn * f AS predicted_won, bd * f AS predicted_daily_profit,
  CASE WHEN bw * f > 0 THEN (bp * f) / (bw * f) * 100 ELSE 0 END AS margin_pct FROM factors)"""
FORECAST = with_views("members", "plays", more=BROAD_CTE + REQUEST_CTE)
_FIGURES = (
    "demo_factor",
    "predicted_profit",
    "predicted_wagered",
    "predicted_won",
    "predicted_daily_profit",
    "margin_pct",
)


def _requests(table):
    return table.select(
        F.concat_ws(":", "ship_name", F.col("departure_date").cast("string"), F.col("voyage_duration").cast("string")).alias(
            "request_id"
        ),
        "ship_name",
        F.date_add("departure_date", 364).alias("departure_date"),
        "voyage_duration",
        F.col("avg_passenger_age").alias("avg_age"),
        *[
            F.least(F.col(f"ratio_{g}_per_player"), F.lit(1.0)).alias(f"pct_{g}")
            for g in ("high_tier", "high_risk", "high_income")
        ],
    )


def forecasts(spark, sf):
    # the mart is read for the requests, the history and the comparison: store it once
    table = workdir.materialise(broad_training(spark, sf), "voyage-training")
    return voyage.forecast(_requests(table), table), table


def _rounded_figures(df, names, digits=4):
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in names})


@query(
    "voy04_profit_forecast",
    FORECAST
    + "SELECT request_id, departure_date, match_count, same_month, "
    + ", ".join(f"{rounded(c, 4)} AS {c}" for c in _FIGURES)
    + " FROM forecasts",
)
def profit_forecast(spark, sf):
    rows, _ = forecasts(spark, sf)
    return _rounded_figures(rows, _FIGURES).select(
        "request_id", "departure_date", "match_count", "same_month", *_FIGURES
    )


@query(
    "flt03_widening_fallback",
    FORECAST
    + "SELECT voyage_duration, same_month, count(*) AS requests, sum(match_count)::BIGINT AS matched FROM forecasts GROUP BY ALL",
)
def widening_fallback(spark, sf):
    rows, _ = forecasts(spark, sf)
    return rows.groupBy("voyage_duration", "same_month").agg(
        F.count("*").alias("requests"), F.sum("match_count").alias("matched")
    )


@query(
    "voy05_day_breakdown",
    FORECAST
    + f"""SELECT request_id, CAST(i + 1 AS INTEGER) AS day,
      {rounded('predicted_daily_profit * (0.85::DOUBLE + 0.3::DOUBLE * (CAST(i AS DOUBLE) / greatest(voyage_duration - 1, 1)))', 4)} AS day_profit
      FROM (SELECT *, unnest(range(voyage_duration)) AS i FROM forecasts)""",
)
def day_breakdown(spark, sf):
    rows, _ = forecasts(spark, sf)
    return _rounded_figures(voyage.day_breakdown(rows), ["day_profit"]).select("request_id", "day", "day_profit")


@query(
    "voy06_fleet_comparison",
    FORECAST
    + f"""SELECT compared_ship, voyage_duration, kind, count(*) AS n, {rounded('max(profit)', 4)} AS highest,
      {rounded('min(profit)', 4)} AS lowest FROM (
      SELECT r.request_id, r.voyage_duration, w.ship_name AS compared_ship, w.avg_profit AS profit, 'Historical Avg' AS kind
      FROM forecasts r JOIN wide w ON w.voyage_duration = r.voyage_duration
      UNION ALL SELECT request_id, voyage_duration, ship_name, predicted_profit, 'This Voyage' FROM forecasts) GROUP BY ALL""",
)
def fleet_comparison(spark, sf):
    rows, table = forecasts(spark, sf)
    compared = voyage.comparison(rows, table)
    return compared.groupBy("compared_ship", "voyage_duration", "kind").agg(
        F.count("*").alias("n"),
        round_half_up(F.max("profit"), 4).alias("highest"),
        round_half_up(F.min("profit"), 4).alias("lowest"),
    )


# --- floor plans: one request per ship and month of the session table ---------------------

PORTS_VALUES = ", ".join(f"('{s}', '{p}', {d}, CAST({x} AS DOUBLE), '{k}')" for s, p, d, x, k in P.PORTS)
PROFILE_NAMES = (P.AUTO_PROFILE, *P.PROFILES)
ZONE_VALUES = ", ".join(
    f"('{z}', {n}, {i}, CAST({factor} AS DOUBLE))"
    for z, n, factors in P.ZONES
    for i, factor in enumerate(factors)
)
FLOOR_CTE = (
    DEMAND_CTE
    + f""",
ports(ship_name, departure_port, typical_duration, denomination_shift, port_profile) AS (VALUES {PORTS_VALUES}),
port_list AS (SELECT ship_name, list(DISTINCT departure_port ORDER BY departure_port) AS names FROM ports GROUP BY 1),
monthly AS (SELECT ship_name, CAST(date_trunc('month', play_date) AS DATE) AS month,
  {rounded('CAST(sum(age) AS DOUBLE) / count(*)', 1)} AS avg_age FROM plays JOIN members USING (member_id) GROUP BY ALL),
requests AS (SELECT m.ship_name || ':' || strftime(m.month, '%Y-%m') AS request_id, m.ship_name, m.avg_age,
  CAST(3 + month(m.month) % 8 AS INTEGER) AS duration_days,
  CASE WHEN month(m.month) % 7 = 0 THEN 'Nowhere' ELSE p.names[month(m.month) % len(p.names) + 1] END AS departure_port,
  ([{_listed(PROFILE_NAMES)}])[(year(m.month) + month(m.month)) % {len(PROFILE_NAMES)} + 1] AS profile
  FROM monthly m JOIN port_list p USING (ship_name)),
near AS (SELECT request_id, typical_duration, denomination_shift, port_profile FROM (
  SELECT r.request_id, p.*, row_number() OVER (PARTITION BY r.request_id ORDER BY
    abs(p.typical_duration - r.duration_days), p.typical_duration) AS rn
  FROM requests r JOIN ports p USING (ship_name, departure_port)) WHERE rn = 1),
fallback AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ship_name ORDER BY departure_port, typical_duration) AS rn
  FROM ports) WHERE rn = 1),
matched AS (SELECT r.*, coalesce(n.typical_duration, f.typical_duration) AS typical_duration,
  coalesce(n.denomination_shift, f.denomination_shift) AS denomination_shift,
  coalesce(n.port_profile, f.port_profile) AS port_profile
  FROM requests r LEFT JOIN near n USING (request_id) LEFT JOIN fallback f USING (ship_name)),
shifted AS (SELECT *, CASE profile WHEN 'auto' THEN port_profile WHEN 'young' THEN 'budget' WHEN 'high-rollers' THEN 'high-roller'
   ELSE profile END AS profile_type,
  greatest(-0.5::DOUBLE, least(0.5::DOUBLE, (CASE profile WHEN 'young' THEN -0.35::DOUBLE WHEN 'family' THEN -0.15::DOUBLE
    WHEN 'balanced' THEN 0.0::DOUBLE WHEN 'premium' THEN 0.25::DOUBLE WHEN 'high-rollers' THEN 0.35::DOUBLE
    ELSE denomination_shift END) + (avg_age - 45) / 100.0::DOUBLE + (duration_days - 5) * 0.03::DOUBLE)) AS total_shift FROM matched),
base AS (SELECT ship_name, denomination, demand_pct, row_number() OVER (PARTITION BY ship_name ORDER BY denomination) - 1 AS i,
  count(*) OVER (PARTITION BY ship_name) AS n FROM demand),
tilted AS (SELECT s.request_id, s.ship_name, s.total_shift, b.denomination, b.i,
  b.demand_pct * greatest(0.3::DOUBLE, least(3.0::DOUBLE, 1 + s.total_shift * (2 * (CAST(b.i AS DOUBLE) / greatest(b.n - 1, 1)) - 1))) AS x
  FROM shifted s JOIN base b USING (ship_name)),
adjusted AS (SELECT *, x / sum(x) OVER (PARTITION BY request_id) * 100 AS pct FROM tilted),
zones(zone, machines, i, factor) AS (VALUES {ZONE_VALUES}),
zoned AS (SELECT a.request_id, a.ship_name, z.zone, z.machines, a.denomination, a.i, a.pct * z.factor AS x
  FROM adjusted a JOIN zones z ON z.i = a.i),
shares AS (SELECT *, x / sum(x) OVER (PARTITION BY request_id, zone) * 100 AS pct FROM zoned),
parts AS (SELECT *, floor(pct * machines / 100.0::DOUBLE) AS base, pct * machines / 100.0::DOUBLE AS raw FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, zone ORDER BY round(raw - base, 9) DESC, i) AS rk,
  machines - sum(base) OVER (PARTITION BY request_id, zone) AS short FROM parts),
allocated AS (SELECT *, CAST(base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS INTEGER) AS allocated FROM ranked)"""
)
FLOOR = with_views("members", "plays", more=FLOOR_CTE)


def floor_requests(spark, sf):
    """Planning requests: the passengers of every ship and month, over all profiles."""
    month = F.trunc("play_date", "MM").alias("month")
    plays = tables.plays(spark, sf, games=False).select("ship_name", month, "member_id")
    ages = demand.ship_mix(plays, tables.members(spark, sf), by=("ship_name", "month"))
    port_lists: dict[str, set[str]] = {}
    for ship, port, *_ in P.PORTS:
        port_lists.setdefault(ship, set()).add(port)
    known = F.create_map(
        *[x for ship, names in port_lists.items() for x in (F.lit(ship), F.array(*[F.lit(p) for p in sorted(names)]))]
    )
    number = F.month("month")
    options = F.try_element_at(known, F.col("ship_name"))
    profiles = F.array(*[F.lit(p) for p in PROFILE_NAMES])
    return ages.select(
        F.concat_ws(":", "ship_name", F.date_format("month", "yyyy-MM")).alias("request_id"),
        "ship_name",
        F.col("avg_passenger_age").alias("avg_age"),
        (F.lit(3) + number % 8).cast("int").alias("duration_days"),
        F.when(number % 7 == 0, "Nowhere").otherwise(F.get(options, number % F.size(options))).alias("departure_port"),
        F.get(profiles, (F.year("month") + number) % len(PROFILE_NAMES)).alias("profile"),
    )


def floor_plan(spark, sf):
    return floor.plan(floor_requests(spark, sf), P.ports(spark), demand_mart(spark, sf))


@query(
    "jon11_nearest_port",
    FLOOR + "SELECT request_id, departure_port, duration_days, typical_duration, denomination_shift, port_profile FROM matched",
)
def nearest_port(spark, sf):
    return demand.with_port(floor_requests(spark, sf), P.ports(spark)).select(
        "request_id", "departure_port", "duration_days", "typical_duration", "denomination_shift", "port_profile"
    )


_NOTE_SQL = """CASE WHEN total_shift > 0.05 THEN 'Higher denominations' WHEN total_shift < -0.05 THEN 'Lower denominations'
  ELSE 'Balanced mix' END AS shift_note"""


@query(
    "dem02_profile_shift",
    FLOOR + f"SELECT request_id, profile_type, {rounded('total_shift', 8)} AS total_shift, {_NOTE_SQL} FROM shifted",
)
def profile_shift(spark, sf):
    rows = demand.with_shift(floor_requests(spark, sf), P.ports(spark))
    return _rounded_figures(rows, ["total_shift"], 8).select("request_id", "profile_type", "total_shift", "shift_note")


@query(
    "dem03_shifted_demand",
    FLOOR + f"SELECT request_id, denomination, {rounded('pct', 6)} AS adjusted_pct FROM adjusted",
)
def shifted_demand(spark, sf):
    shifted = demand.shifted_demand(
        demand.with_shift(floor_requests(spark, sf), P.ports(spark)), demand_mart(spark, sf)
    )
    cells = shifted.select("request_id", F.explode(F.arrays_zip("denominations", "adjusted_pcts")).alias("c"))
    return cells.select(
        "request_id",
        F.col("c.denominations").alias("denomination"),
        round_half_up(F.col("c.adjusted_pcts"), 6).alias("adjusted_pct"),
    )


@query(
    "flr01_zone_demand",
    FLOOR + f"SELECT request_id, zone, denomination, {rounded('pct', 6)} AS zone_pct FROM shares",
)
def zone_demand(spark, sf):
    rows = floor.allocation_rows(floor_plan(spark, sf))
    return rows.select("request_id", "zone", "denomination", round_half_up(F.col("zone_pct"), 6).alias("zone_pct"))


@query(
    "flr02_allocate",
    FLOOR + "SELECT request_id, zone, machines, denomination, allocated FROM allocated",
)
def allocate_machines(spark, sf):
    return floor.allocation_rows(floor_plan(spark, sf)).select(
        "request_id", "zone", "machines", "denomination", "allocated"
    )


@query(
    "flr02_allocate_fleet_bank",
    with_views("members", "plays", more=DEMAND_CTE)
    + """, p AS (SELECT ship_name, denomination, demand_pct * 148 / 100.0::DOUBLE AS raw,
      floor(demand_pct * 148 / 100.0::DOUBLE) AS base FROM demand)
    SELECT ship_name, denomination, CAST(base + CASE WHEN row_number() OVER (PARTITION BY ship_name
      ORDER BY round(raw - base, 9) DESC, denomination) <= 148 - sum(base) OVER (PARTITION BY ship_name) THEN 1 ELSE 0 END AS INTEGER)
      AS allocated FROM p""",
)
def allocate_fleet_bank(spark, sf):
    """The whole bank of each ship allocated by its plain demand shares (long form)."""
    sized = demand_mart(spark, sf).withColumn("bank_size", F.lit(P.total_machines()))
    return allocate(sized, ["ship_name"], "bank_size", "demand_pct", "denomination").select(
        "ship_name", "denomination", "allocated"
    )


@query(
    "flr03_zone_summary",
    FLOOR
    + """SELECT request_id, zone, machines, denomination AS top_denomination FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, zone ORDER BY allocated DESC, i) AS rn FROM allocated) WHERE rn = 1""",
)
def zone_summary(spark, sf):
    return floor_plan(spark, sf).select("request_id", "zone", "machines", "top_denomination")


@query(
    "flr03_plan_summary",
    FLOOR
    + f"""SELECT s.request_id, s.ship_name, s.profile_type, {_NOTE_SQL}, t.total_machines, t.zones FROM shifted s JOIN (
      SELECT request_id, sum(allocated)::BIGINT AS total_machines, count(DISTINCT zone) AS zones FROM allocated GROUP BY 1) t
      USING (request_id)""",
)
def plan_summary(spark, sf):
    return floor.summary(floor_plan(spark, sf))


@query(
    "flt11_used_machines",
    FLOOR + "SELECT request_id, zone, denomination, allocated FROM allocated WHERE allocated > 0",
)
def used_machines(spark, sf):
    return floor.allocation_rows(floor_plan(spark, sf), only_used=True).select(
        "request_id", "zone", "denomination", "allocated"
    )


@query(
    "flt11_visible_demand",
    FLOOR
    + f"""SELECT request_id, denomination, {rounded('pct', 1)} AS demand_pct FROM adjusted
      WHERE {rounded('pct', 1)} > 0.5""",
)
def visible_demand(spark, sf):
    shifted = demand.shifted_demand(
        demand.with_shift(floor_requests(spark, sf), P.ports(spark)), demand_mart(spark, sf)
    )
    return floor.ship_wide_demand(shifted)
