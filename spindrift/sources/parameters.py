"""Parameter tables. All of them have a size fixed here, in code.

They are small enough to broadcast by construction; nothing in this module grows
with the data.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: vocabularies in their natural (ordinal) order -----------------------
TIERS = ("Basic", "Bronze", "Silver", "Gold", "Platinum")
RISKS = ("Conservative", "Moderate", "Aggressive", "High Roller")
MARITAL = ("Single", "Married", "Divorced", "Widowed")
INCOMES = ("Under $50K", "$50K-$100K", "$100K-$150K", "$150K-$250K", "Over $250K")
GENDERS = ("M", "F")
TIMES_OF_DAY = ("Morning", "Afternoon", "Evening", "Night")
GAME_TYPES = ("Video Slots", "Classic Slots", "Progressive", "Multi-Line")
HOME_STATES = ("FL", "TX", "CA", "NY", "GA", "NC", "PA", "OH", "AZ", "NV")
BETS = (1, 2, 3, 5, 10)
DENOMINATIONS = ("0.01", "0.05", "0.25", "1.00", "5.00", "10.00", "20.00", "50.00", "100.00")
SHIPS = ("Ship A", "Ship B", "Ship C", "Ship D", "Ship E", "Ship F", "Ship G", "Ship H")

# --- fixed values: passenger groups counted by the marts -------------------------------
HIGH_TIER = ("Gold", "Platinum")
HIGH_INCOME = ("$150K-$250K", "Over $250K")
HIGH_RISK = ("Aggressive", "High Roller")

# --- fixed values: denomination weights per ship (each row adds up to 100) -------------
SHIP_WEIGHTS = {
    "Ship A": ("25", "20", "20", "15", "8", "5", "3.5", "2", "1.5"),
    "Ship B": ("2", "3", "5", "8", "12", "15", "18", "22", "15"),
    "Ship C": ("3", "4", "6", "10", "12", "17", "18", "16", "14"),
    "Ship D": ("8", "10", "14", "18", "16", "13", "9", "7", "5"),
    "Ship E": ("20", "17", "15", "14", "12", "8", "6", "4", "4"),
    "Ship F": ("15", "14", "13", "14", "13", "11", "8", "7", "5"),
    "Ship G": ("8", "10", "12", "15", "15", "14", "10", "9", "7"),
    "Ship H": ("10", "12", "13", "15", "14", "12", "9", "8", "7"),
}

# --- fixed values: threshold bins -------------------------------------------------------
BET_EDGES = ((2, "Low"), (4, "Medium"), (7, "High"))
BET_LAST = "VeryHigh"
WIN_RATE_EDGES = ((80, "Very_Low"), (85, "Low"), (90, "Medium"), (95, "High"))
WIN_RATE_LAST = "Very_High"

# --- fixed values: machine zones (id, machines, factor by denomination index) ----
ZONES = (
    ("A", 16, (1.0, 1.0, 1.5, 1.5, 1.5, 1.5, 1.0, 1.0, 1.0)),
    ("B", 20, (1.0,) * 9),
    ("C", 32, (1.0,) * 9),
    ("D", 12, (0.3, 0.3, 0.3, 1.0, 1.8, 1.8, 1.8, 1.8, 1.8)),
    ("E", 8, (0.1, 0.1, 0.1, 0.1, 0.1, 2.5, 2.5, 2.5, 2.5)),
    ("F", 24, (1.8, 1.8, 1.8, 1.8, 1.0, 1.0, 0.3, 0.3, 0.3)),
    ("G", 20, (1.0,) * 9),
    ("H", 16, (1.0,) * 9),
)

# --- fixed values: passenger profile -> (shift, profile type); "auto" keeps the port's own.
# The keys are request codes of our own.
PROFILES = {
    "young": (-0.35, "budget"),
    "family": (-0.15, "family"),
    "balanced": (0.0, "balanced"),
    "premium": (0.25, "premium"),
    "high-rollers": (0.35, "high-roller"),
}
AUTO_PROFILE = "auto"
SHIFT_LIMIT = 0.5
FACTOR_RANGE = (0.3, 3.0)
NEUTRAL_AGE = 45
NEUTRAL_DURATION = 5
SHIFT_PER_DAY = 0.03
SHIFT_NOTE_BAND = 0.05

# --- fixed values: sample ports (ship, port, typical duration, shift, profile) ----------
PORTS = (
    ("Ship A", "Northport", 4, -0.20, "party"),
    ("Ship A", "Northport", 6, -0.05, "family"),
    ("Ship A", "Eastbay", 5, -0.10, "family"),
    ("Ship B", "Eastbay", 7, 0.30, "premium"),
    ("Ship B", "Southquay", 5, 0.20, "premium"),
    ("Ship C", "Southquay", 6, 0.30, "high-roller"),
    ("Ship C", "Westhaven", 4, 0.15, "premium"),
    ("Ship C", "Westhaven", 8, 0.25, "premium"),
    ("Ship D", "Westhaven", 5, 0.00, "balanced"),
    ("Ship D", "Gulfmouth", 7, 0.05, "balanced"),
    ("Ship E", "Gulfmouth", 3, -0.30, "budget"),
    ("Ship E", "Northport", 5, -0.10, "family"),
    ("Ship F", "Lagoon", 6, -0.05, "balanced"),
    ("Ship F", "Eastbay", 4, -0.15, "party"),
    ("Ship G", "Lagoon", 7, 0.10, "premium"),
    ("Ship G", "Capeview", 5, 0.05, "balanced"),
    ("Ship H", "Capeview", 6, 0.00, "balanced"),
    ("Ship H", "Southquay", 4, -0.10, "family"),
    ("Ship H", "Southquay", 8, 0.10, "premium"),
)

# --- fixed values: voyages --------------------------------------------------------------
DURATIONS = (3, 4, 5, 6, 7)
TAIL_DAYS = 7
VOYAGE_DEFAULTS = {
    "avg_passenger_age": 50.0,
    "pct_male": 0.5,
    "pct_high_tier": 0.2,
    "pct_high_income": 0.2,
    "pct_high_risk": 0.3,
    "avg_cruises": 10.0,
    "avg_lifetime_spend": 20000.0,
}
FORECAST_WEIGHTS = {"high_tier": 0.3, "high_risk": 0.2, "high_income": 0.25, "age": 0.1}
FORECAST_RANGE = (0.5, 2.0)
DAY_FACTOR = (0.85, 0.3)

# --- fixed values: what-if defaults of a ship day ---------------------------------------
SHIP_DAY_DEFAULTS = {"avg_spins": 250.0, "avg_bet_per_spin": 4.2, "avg_session_mins": 65.0}
SHIP_DAY_WAGER_FACTOR = 0.5
SHIP_DAY_SHARES = {"night_sessions": 0.3, "evening_sessions": 0.37, "progressive_sessions": 0.25}

# --- fixed values: sentences and labels shown to users ----------------------------------
MEMBER_LABEL = "%d — %s, Age %d, %s, %s risk, %s"
NOT_FOUND_TEXT = "Member %d not found"
DENOMINATION_TEXT = "Predicted preferred denomination for member %d: %s"
BET_TEXT = "Predicted bet category for member %d: %s"
CONTEXT_TEXT = "Predicted optimal denomination for member %d: %s (Age: %d, Tier: %s, Income: %s, Risk: %s)"
SHIP_DAY_TEXT = "Predicted win rate category for %s on day %d with %d sessions: %s"
SHIFT_NOTES = ("Higher denominations", "Lower denominations", "Balanced mix")
HISTORY_KIND = "Historical Avg"
REQUEST_KIND = "This Voyage"


def ship_weights(spark: SparkSession) -> DataFrame:
    """Long form of the weights: ship_name, denomination, weight (72 rows)."""
    rows = [
        (ship, Decimal(denom), Decimal(weight))
        for ship, weights in SHIP_WEIGHTS.items()
        for denom, weight in zip(DENOMINATIONS, weights)
    ]
    schema = "ship_name string, denomination decimal(10,2), weight decimal(10,2)"
    return spark.createDataFrame(rows, schema)


def ports(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("ship_name", T.StringType()),
            T.StructField("departure_port", T.StringType()),
            T.StructField("typical_duration", T.IntegerType()),
            T.StructField("denomination_shift", T.DoubleType()),
            T.StructField("port_profile", T.StringType()),
        ]
    )
    return spark.createDataFrame(list(PORTS), schema)


def total_machines() -> int:
    return reduce(lambda acc, zone: acc + zone[1], ZONES, 0)
