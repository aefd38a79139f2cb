"""Demand by denomination: redistribution, demand mart, and profile-shifted demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.encode import decode
from spindrift.functions.numeric import clip, ratio, round_half_up
from spindrift.operators.allocate import normalise
from spindrift.operators.cdf import assign_category_by_cdf
from spindrift.plans.mix import MIX_COLUMNS, Groups, flags, mix_sums
from spindrift.sources import parameters as P
from spindrift.sources.tables import with_money


def redistribute(plays: DataFrame, weights: DataFrame, u: str = "u", payout: str = "payout") -> DataFrame:
    """Redraw every session's denomination from its ship's weights and recompute the money."""
    assigned = assign_category_by_cdf(plays, weights, u)
    return with_money(assigned, F.col(payout)).select(*plays.columns)


def ship_denomination_days(plays: DataFrame) -> DataFrame:
    """Sessions reduced to one row per (ship, denomination, member)."""
    return plays.groupBy("ship_name", "denomination", "member_id").agg(
        F.count("*").alias("sessions"),
        F.sum("total_wagered").alias("wagered"),
        F.sum("num_spins").alias("spins"),
        F.sum("bet_per_spin").alias("bets"),
    )


def bank_demand(plays: DataFrame, members: DataFrame, groups: Groups = Groups()) -> DataFrame:
    """Demand mart: one row per ship and denomination with shares and the ship's mix.

    One pass over the sessions: the per-member partials feed both the denomination
    statistics and the passenger mix. The ship totals are windows over the grouped
    result, which has ships x denominations rows.
    """
    per_member = ship_denomination_days(plays).join(flags(members, groups), "member_id", "left")
    sums = {
        "session_count": F.sum("sessions"),
        "total_wagered": F.sum("wagered"),
        "spins": F.sum("spins"),
        "bets": F.sum("bets"),
        "unique_players": F.count("member_id"),
        **mix_sums(),
    }
    stats = per_member.groupBy("ship_name", "denomination").agg(*[c.alias(n) for n, c in sums.items()])
    ship = Window.partitionBy("ship_name")

    def share(name: str, digits: int) -> Column:
        return round_half_up(ratio(F.col(name) * 100, F.sum(name).over(ship)), digits)

    def ship_mean(name: str, digits: int) -> Column:
        return round_half_up(ratio(F.sum(name).over(ship), F.sum("mix_sessions").over(ship)), digits)

    n = F.col("session_count")
    return stats.select(
        "ship_name",
        "denomination",
        "session_count",
        share("session_count", 2).alias("demand_pct"),
        F.col("total_wagered").cast("double").alias("total_wagered"),
        share("total_wagered", 2).alias("wagered_pct"),
        round_half_up(ratio(F.col("spins"), n), 0).alias("avg_spins"),
        round_half_up(ratio(F.col("bets"), n), 2).alias("avg_bet"),
        "unique_players",
        ship_mean("mix_age", 1).alias("avg_passenger_age"),
        ship_mean("mix_male", 3).alias("pct_male"),
        ship_mean("mix_high_tier", 3).alias("pct_high_tier"),
        ship_mean("mix_high_income", 3).alias("pct_high_income"),
        ship_mean("mix_high_risk", 3).alias("pct_high_risk"),
        ship_mean("mix_cruises", 1).alias("avg_cruises"),
        ship_mean("mix_spend", 0).alias("avg_lifetime_spend"),
    )


def mix_means() -> list[Column]:
    """Session-weighted averages out of ``mix_sums``."""

    def mean(name: str, digits: int) -> Column:
        return round_half_up(ratio(F.col(name), F.col("mix_sessions")), digits)

    return [
        mean("mix_age", 1).alias("avg_passenger_age"),
        mean("mix_male", 3).alias("pct_male"),
        mean("mix_high_tier", 3).alias("pct_high_tier"),
        mean("mix_high_income", 3).alias("pct_high_income"),
        mean("mix_high_risk", 3).alias("pct_high_risk"),
        mean("mix_cruises", 1).alias("avg_cruises"),
        mean("mix_spend", 0).alias("avg_lifetime_spend"),
    ]


def ship_mix(plays: DataFrame, members: DataFrame, groups: Groups = Groups(), by: tuple[str, ...] = ("ship_name",)) -> DataFrame:
    """Passenger mix per group as session-weighted averages."""
    partials = plays.groupBy(*by, "member_id").agg(F.count("*").alias("sessions"))
    joined = partials.join(flags(members, groups), "member_id")
    sums = joined.groupBy(*by).agg(*[c.alias(n) for n, c in mix_sums().items()])
    return sums.select(*by, *mix_means())


def demand_profiles(demand: DataFrame) -> DataFrame:
    """One row per ship with parallel arrays of denominations and demand shares."""
    pairs = F.array_sort(F.collect_list(F.struct("denomination", "demand_pct")))
    return (
        demand.groupBy("ship_name")
        .agg(pairs.alias("pairs"))
        .select(
            "ship_name",
            F.transform("pairs", lambda p: p["denomination"]).alias("denominations"),
            F.transform("pairs", lambda p: p["demand_pct"]).alias("base_pcts"),
        )
    )


def with_port(requests: DataFrame, ports: DataFrame) -> DataFrame:
    """Attach the port row whose typical duration is nearest to the requested one.

    A request whose (ship, port) is unknown falls back to its ship's first port row.
    The port table is a parameter table; it is folded into one array per key so that the
    choice is made inside the request row, without grouping the requests.
    """
    option = F.struct("departure_port", "typical_duration", "denomination_shift", "port_profile")
    by_port = ports.groupBy("ship_name", "departure_port").agg(F.collect_list(option).alias("_here"))
    by_ship = ports.groupBy("ship_name").agg(F.array_min(F.collect_list(option)).alias("_fallback"))
    joined = requests.join(by_port, ["ship_name", "departure_port"], "left").join(by_ship, "ship_name", "left")
    wanted = F.col("duration_days")
    nearest = F.array_min(
        F.transform(
            "_here",
            lambda p: F.struct(
                F.abs(p["typical_duration"] - wanted).alias("distance"),
                p["typical_duration"].alias("typical_duration"),
                p["denomination_shift"].alias("denomination_shift"),
                p["port_profile"].alias("port_profile"),
            ),
        )
    )
    chosen = joined.withColumn("_near", nearest)
    fields = ("typical_duration", "denomination_shift", "port_profile")
    return chosen.select(
        *requests.columns,
        *[F.coalesce(F.col("_near")[f], F.col("_fallback")[f]).alias(f) for f in fields],
    )


def with_shift(requests: DataFrame, ports: DataFrame) -> DataFrame:
    """Total demand shift per request: profile override or port, plus age and duration.

    Whatever is not known (no profile and no port of the ship, no age, no duration) shifts nothing.
    """
    matched = with_port(requests, ports)
    profile = F.col("profile")
    shift = F.coalesce(decode(profile, {k: v[0] for k, v in P.PROFILES.items()}), F.col("denomination_shift"))
    kind = F.coalesce(decode(profile, {k: v[1] for k, v in P.PROFILES.items()}), F.col("port_profile"))
    age = (F.col("avg_age") - P.NEUTRAL_AGE) / 100.0
    duration = (F.col("duration_days") - P.NEUTRAL_DURATION) * F.lit(P.SHIFT_PER_DAY)
    known = [F.coalesce(part.cast("double"), F.lit(0.0)) for part in (shift, age, duration)]
    total = clip(known[0] + known[1] + known[2], -P.SHIFT_LIMIT, P.SHIFT_LIMIT)
    up, down, neutral = P.SHIFT_NOTES
    note = F.when(total > P.SHIFT_NOTE_BAND, up).when(total < -P.SHIFT_NOTE_BAND, down).otherwise(neutral)
    return matched.withColumns(
        {"profile_type": kind, "total_shift": total, "shift_note": note}
    )


def shifted_demand(requests_with_shift: DataFrame, demand: DataFrame) -> DataFrame:
    """Tilt each request's share vector towards high or low denominations.

    Position i of n carries weight i/(n-1); its factor is 1 + shift * (2w - 1), clipped,
    and the vector is scaled back to 100. One join on the ship, no shuffle per request.
    """
    joined = requests_with_shift.join(demand_profiles(demand), "ship_name")
    low, high = P.FACTOR_RANGE
    last = F.greatest(F.size("base_pcts") - 1, F.lit(1))

    def tilt(pct: Column, i: Column) -> Column:
        position = i.cast("double") / last.cast("double")
        return pct * clip(F.lit(1.0) + F.col("total_shift") * (F.lit(2.0) * position - 1.0), low, high)

    return joined.withColumn("adjusted_pcts", normalise(F.transform("base_pcts", tilt))).drop("base_pcts")
