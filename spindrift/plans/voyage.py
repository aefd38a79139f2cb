"""Rolling voyages: training mart, profit forecast and comparisons.

A voyage is a ship, a departure day and a duration. Sessions are read once and reduced
to ship days; everything about voyages is then computed on that small calendar frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import calendar
from spindrift.functions.numeric import clip, exact_avg, ratio
from spindrift.operators.rolling import newcomer_counts, rolling_distinct, rolling_sum, with_gap
from spindrift.plans.daily import member_days
from spindrift.plans.mix import MIX_COLUMNS, VOYAGE_GROUPS, Groups, flags, mix_sums
from spindrift.sources import parameters as P
from spindrift.sources import workdir

MIX_RATIOS = {
    "ratio_male_per_player": ("mix_male", "pct_male"),
    "ratio_high_tier_per_player": ("mix_high_tier", "pct_high_tier"),
    "ratio_high_income_per_player": ("mix_high_income", "pct_high_income"),
    "ratio_high_risk_per_player": ("mix_high_risk", "pct_high_risk"),
}
MIX_MEANS = {
    "avg_passenger_age": "mix_age",
    "avg_cruises": "mix_cruises",
    "avg_lifetime_spend": "mix_spend",
}


def voyage_days(
    plays: DataFrame, members: DataFrame, groups: Groups = VOYAGE_GROUPS, longest: int = max(P.DURATIONS)
) -> DataFrame:
    """Ship days with money, traffic, mix sums and newcomer counts, from one scan.

    Steps: sessions -> (ship, day, member) partials (map-side combined) -> join to the
    members -> days since the member's previous day on the ship -> ship days. The join
    and the gap window are both on the member, so one exchange can serve both.
    """
    partials = member_days(plays).join(flags(members, groups), "member_id", "left")
    known = F.coalesce(F.col("known"), F.lit(False))
    gapped = with_gap(partials, ["ship_name"], "member_id", "play_date")
    aggregates = {
        "sessions": F.sum("sessions"),
        "unique_players": F.count("member_id"),
        "wagered": F.sum("wagered"),
        "won": F.sum("won"),
        **mix_sums(),
        **newcomer_counts(F.col("gap_days"), known, longest, "new"),
    }
    return gapped.groupBy("ship_name", "play_date").agg(*[c.alias(n) for n, c in aggregates.items()])


def stored_voyage_days(
    plays: DataFrame, members: DataFrame, groups: Groups = VOYAGE_GROUPS, longest: int = max(P.DURATIONS)
) -> DataFrame:
    """The ship days written to the shared folder: sessions are read exactly once."""
    return workdir.materialise(voyage_days(plays, members, groups, longest), "ship-days")


def rolling_voyages(
    days: DataFrame, durations: tuple[int, ...] = P.DURATIONS, tail_days: int = P.TAIL_DAYS
) -> DataFrame:
    """Sums per (ship, departure, duration); departures in the last ``tail_days`` drop out.

    All frames share one (ship, day) sort. ``days`` is the stored ship-day table: it has at
    most ships x calendar days rows, which does not grow with the sessions.
    """
    ship = ["ship_name"]
    numbered = days.withColumn("day_no", calendar.day_number(F.col("play_date")))
    summed = {"days_present": "1", **{c: c for c in ("sessions", "unique_players", "wagered", "won", *MIX_COLUMNS)}}

    def one(duration: int) -> str:
        fields = [f"'voyage_duration', {duration}"]
        fields += [f"'{name}', {rolling_sum(c, ship, 'day_no', duration)}" for name, c in summed.items()]
        fields.append(f"'distinct_players', {rolling_distinct('new', ship, 'day_no', duration)}")
        return f"named_struct({', '.join(fields)})"

    voyages = numbered.selectExpr(
        "ship_name",
        "play_date AS departure_date",
        f"array({', '.join(one(d) for d in durations)}) AS voyages",
    )
    # a scalar subquery on the stored ship days; as a window, the fleet maximum would drag
    # the rolling sums of all ships into its single partition
    last_departure = days.agg(F.date_sub(F.max("play_date"), tail_days).alias("last"))
    return (
        voyages.where(F.col("departure_date") <= last_departure.scalar())
        .select("ship_name", "departure_date", F.explode("voyages").alias("v"))
        .select("ship_name", "departure_date", "v.*")
    )


def training(
    plays: DataFrame,
    members: DataFrame,
    groups: Groups = VOYAGE_GROUPS,
    durations: tuple[int, ...] = P.DURATIONS,
    tail_days: int = P.TAIL_DAYS,
) -> DataFrame:
    """Voyage training mart: money, traffic and passenger mix of every rolling voyage.

    The mix ratios divide sessions by *distinct* players and may exceed 1, hence their
    names; a voyage without any known member gets the documented defaults.
    """
    days = stored_voyage_days(plays, members, groups, max(durations))
    return with_measures(rolling_voyages(days, durations, tail_days))


def with_measures(voyages: DataFrame) -> DataFrame:
    present, players = F.col("days_present"), F.col("distinct_players")
    defaults = P.VOYAGE_DEFAULTS

    def mean(name: str) -> Column:
        value = ratio(F.col(MIX_MEANS[name]), F.col("mix_sessions"))
        return F.coalesce(value, F.lit(defaults[name])).alias(name)

    def per_player(name: str) -> Column:
        column, default = MIX_RATIOS[name]
        return F.coalesce(ratio(F.col(column), players), F.lit(defaults[default])).alias(name)

    return voyages.select(
        "ship_name",
        "departure_date",
        "voyage_duration",
        F.month("departure_date").alias("departure_month"),
        calendar.dow_sun0(F.col("departure_date")).alias("departure_dow_sun0"),
        F.col("wagered").cast("double").alias("total_wagered"),
        F.col("won").cast("double").alias("total_won"),
        (F.col("wagered") - F.col("won")).cast("double").alias("total_profit"),
        ratio(F.col("sessions"), present).alias("avg_daily_sessions"),
        ratio(F.col("unique_players"), present).alias("avg_daily_players"),
        mean("avg_passenger_age"),
        *[per_player(name) for name in MIX_RATIOS],
        mean("avg_cruises"),
        mean("avg_lifetime_spend"),
    )


# --- forecast ---------------------------------------------------------------------------


def _money_means() -> dict[str, Column]:
    def mean(name: str) -> Column:
        return ratio(F.sum(F.col(name).cast("decimal(20,2)")), F.count("*"))

    profit = F.sum(F.col("total_profit").cast("decimal(20,2)"))
    return {
        "avg_profit": mean("total_profit"),
        "avg_wagered": mean("total_wagered"),
        "avg_won": mean("total_won"),
        # the duration is constant within a group
        "avg_daily_profit": ratio(profit, F.count("*") * F.first("voyage_duration")),
        "match_count": F.count("*"),
    }


def historical_averages(training_table: DataFrame, by_month: bool) -> DataFrame:
    """Average money per (ship, duration[, month]) for all keys at once."""
    keys = ["ship_name", "voyage_duration"] + (["departure_month"] if by_month else [])
    return training_table.groupBy(*keys).agg(*[c.alias(n) for n, c in _money_means().items()])


def historical_mix(training_table: DataFrame) -> DataFrame:
    """Average passenger mix per (ship, duration)."""
    return training_table.groupBy("ship_name", "voyage_duration").agg(
        exact_avg(F.col("ratio_high_tier_per_player")).alias("hist_high_tier"),
        exact_avg(F.col("ratio_high_risk_per_player")).alias("hist_high_risk"),
        exact_avg(F.col("ratio_high_income_per_player")).alias("hist_high_income"),
        exact_avg(F.col("avg_passenger_age")).alias("hist_age"),
    )


def history(training_table: DataFrame) -> DataFrame:
    """Everything the forecast needs per (ship, duration), as one row.

    The exact-month averages are kept in a map with at most twelve entries; the wider
    averages come from the monthly ones. A request then needs a single join.
    """
    money = ("total_profit", "total_wagered", "total_won")
    mixes = {
        "hist_high_tier": "ratio_high_tier_per_player",
        "hist_high_risk": "ratio_high_risk_per_player",
        "hist_high_income": "ratio_high_income_per_player",
        "hist_age": "avg_passenger_age",
    }
    monthly = training_table.groupBy("ship_name", "voyage_duration", "departure_month").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(m).cast("decimal(20,2)")).alias(m) for m in money],
        *[F.sum(F.col(c).cast("decimal(28,12)")).alias(h) for h, c in mixes.items()],
    )

    def averages(n: Column, sums: dict[str, Column]) -> Column:
        return F.struct(
            n.alias("match_count"),
            *[ratio(sums[m], n).alias(m) for m in money],
            ratio(sums["total_profit"], n * F.col("voyage_duration")).alias("daily_profit"),
        )

    exact = averages(F.col("n"), {m: F.col(m) for m in money})
    with_exact = monthly.withColumn("exact", exact)
    return with_exact.groupBy("ship_name", "voyage_duration").agg(
        averages(F.sum("n"), {m: F.sum(m) for m in money}).alias("wide"),
        F.map_from_entries(F.collect_list(F.struct("departure_month", "exact"))).alias("by_month"),
        *[ratio(F.sum(h), F.sum("n")).alias(h) for h in mixes],
    )


def demographic_factor() -> Column:
    """Product of 1 + k * relative deviation for each mix measure with history, clamped.

    A measure that the request leaves out has no effect.
    """
    weights = P.FORECAST_WEIGHTS
    factor = F.lit(1.0)
    for group in ("high_tier", "high_risk", "high_income"):
        hist, asked = F.col(f"hist_{group}"), F.col(f"pct_{group}")
        step = F.lit(1.0) + F.lit(weights[group]) * (asked - hist) / F.greatest(hist, F.lit(0.01))
        factor = factor * F.when((hist > 0) & asked.isNotNull(), step).otherwise(F.lit(1.0))
    hist, asked = F.col("hist_age"), F.col("avg_age")
    step = F.lit(1.0) + F.lit(weights["age"]) * (asked - hist) / F.nullif(hist, F.lit(0.0))
    factor = factor * F.when((hist > 0) & asked.isNotNull(), step).otherwise(F.lit(1.0))
    return clip(factor, *P.FORECAST_RANGE)


def forecast(requests: DataFrame, training_table: DataFrame) -> DataFrame:
    """Profit forecast for a table of requests (ship, date, duration, expected mix).

    Uses the averages of the same month if there are any, else those of all months; an
    unknown ship keeps its row with NULL figures.
    """
    joined = requests.join(history(training_table), ["ship_name", "voyage_duration"], "left")
    exact = F.try_element_at("by_month", F.month("departure_date"))
    based = joined.withColumn("base", F.coalesce(exact, F.col("wide"))).withColumn(
        "demo_factor", F.when(F.col("base").isNotNull(), demographic_factor())
    )
    factor = F.col("demo_factor")
    wagered = F.col("base.total_wagered") * factor
    profit = F.col("base.total_profit") * factor
    margin = F.when(wagered > 0, profit / F.nullif(wagered, F.lit(0.0)) * 100).when(wagered <= 0, 0.0)
    return based.select(
        *requests.columns,
        F.col("base.match_count").alias("match_count"),
        exact.isNotNull().alias("same_month"),
        "demo_factor",
        profit.alias("predicted_profit"),
        wagered.alias("predicted_wagered"),
        (F.col("base.total_won") * factor).alias("predicted_won"),
        (F.col("base.daily_profit") * factor).alias("predicted_daily_profit"),
        margin.alias("margin_pct"),
    )


def day_breakdown(forecasts: DataFrame) -> DataFrame:
    """Rising daily profile of each forecast: one row per voyage day."""
    start, rise = P.DAY_FACTOR
    last = F.greatest(F.col("voyage_duration") - 1, F.lit(1))
    days = forecasts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("voyage_duration") - 1)))
    profit = F.col("predicted_daily_profit") * (F.lit(start) + F.lit(rise) * (F.col("i") / last))
    return days.select(*forecasts.columns, (F.col("i") + 1).alias("day"), profit.alias("day_profit"))


def average_profit_by_ship(training_table: DataFrame) -> DataFrame:
    profit = F.sum(F.col("total_profit").cast("decimal(20,2)"))
    return training_table.groupBy("ship_name", "voyage_duration").agg(
        ratio(profit, F.count("*")).alias("avg_profit")
    )


def comparison(forecasts: DataFrame, training_table: DataFrame) -> DataFrame:
    """Each forecast next to every ship's historical average at the same duration.

    The averages are gathered into one short array per duration (one entry per ship), so
    a forecast needs one equi-join and explodes ships + 1 rows.
    """
    averages = average_profit_by_ship(training_table)
    per_duration = averages.groupBy("voyage_duration").agg(
        F.array_sort(F.collect_list(F.struct("ship_name", "avg_profit"))).alias("fleet")
    )
    tagged = F.transform(
        "fleet",
        lambda s: F.struct(
            s["ship_name"].alias("compared_ship"),
            s["avg_profit"].alias("profit"),
            F.lit(P.HISTORY_KIND).alias("kind"),
        ),
    )
    own = F.array(
        F.struct(
            F.col("ship_name").alias("compared_ship"),
            F.col("predicted_profit").alias("profit"),
            F.lit(P.REQUEST_KIND).alias("kind"),
        )
    )
    nobody = F.array().cast("array<struct<compared_ship:string,profit:double,kind:string>>")
    everyone = F.concat(F.coalesce(tagged, nobody), own)
    rows = forecasts.join(per_duration, "voyage_duration", "left").withColumn("row", F.explode(everyone))
    return rows.select("request_id", "voyage_duration", "row.*")
