"""Machine floor plans: zone-specific demand and integer machine allocation.

A plan is computed for a whole table of requests (request_id, ship_name, departure_port,
duration_days, avg_age, profile) at once. Each request row carries its short share
vector, and every zone is derived inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.allocate import allocate_array, first_max_index, normalise
from spindrift.plans.demand import shifted_demand, with_shift
from spindrift.sources import parameters as P


def _zones() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(zone).alias("zone"),
                F.lit(machines).alias("machines"),
                F.array(*[F.lit(x) for x in factors]).alias("factors"),
            )
            for zone, machines, factors in P.ZONES
        ]
    )


def zone_demand(shifted: DataFrame) -> DataFrame:
    """One row per request and zone with the zone's own share vector (adds up to 100).

    Factors go by position; a ship with fewer denominations uses as many of them as it has.
    """
    rows = shifted.withColumn("_zone", F.explode(_zones())).select(*shifted.columns, "_zone.*")
    weighted = F.transform("adjusted_pcts", lambda pct, i: pct * F.coalesce(F.get("factors", i), F.lit(1.0)))
    return rows.withColumn("zone_pcts", normalise(weighted)).drop("factors")


def plan(requests: DataFrame, ports: DataFrame, demand: DataFrame) -> DataFrame:
    """Full floor plan: per request and zone the allocated machines per denomination."""
    zones = zone_demand(shifted_demand(with_shift(requests, ports), demand))
    allocated = zones.withColumn("allocated", allocate_array(F.col("zone_pcts"), F.col("machines")))
    top = F.element_at("denominations", first_max_index(F.col("allocated")) + 1)
    return allocated.withColumn("top_denomination", top)


def allocation_rows(planned: DataFrame, only_used: bool = False) -> DataFrame:
    """Long form: one row per request, zone and denomination."""
    cells = F.arrays_zip("denominations", "zone_pcts", "allocated")
    rows = planned.select("request_id", "zone", "machines", F.posexplode(cells).alias("denom_idx", "cell"))
    result = rows.select(
        "request_id",
        "zone",
        "machines",
        "denom_idx",
        F.col("cell.denominations").alias("denomination"),
        F.col("cell.zone_pcts").alias("zone_pct"),
        F.col("cell.allocated").alias("allocated"),
    )
    return result.where("allocated > 0") if only_used else result


def ship_wide_demand(shifted: DataFrame, above_pct: float = 0.5) -> DataFrame:
    """Adjusted demand per denomination (1 digit), small shares left out of the display."""
    cells = F.arrays_zip("denominations", "adjusted_pcts")
    rows = shifted.select("request_id", F.explode(cells).alias("cell")).select(
        "request_id",
        F.col("cell.denominations").alias("denomination"),
        F.round(F.col("cell.adjusted_pcts").cast("decimal(38,10)"), 1).cast("double").alias("demand_pct"),
    )
    return rows.where(F.col("demand_pct") > above_pct)


def summary(planned: DataFrame) -> DataFrame:
    """One row per request: machines placed, zones, profile and the shift in words."""
    placed = F.aggregate("allocated", F.lit(0), lambda acc, x: acc + x)
    return planned.groupBy("request_id", "ship_name", "profile_type", "shift_note").agg(
        F.sum(placed).alias("total_machines"), F.count("*").alias("zones")
    )
