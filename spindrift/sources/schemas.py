"""Declared schemas, keys and enumerations, and the checks that go with them.

Parquet does not enforce keys, so each declaration comes with a distributed check
that returns the offending rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources import parameters as P

MONEY = T.DecimalType(18, 2)
PRICE = T.DecimalType(10, 2)


def _struct(required: Sequence[str] = (), **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


MEMBERS = _struct(
    required=("member_id",),
    member_id=T.LongType(),
    age=T.IntegerType(),
    gender=T.StringType(),
    membership_tier=T.StringType(),
    home_state=T.StringType(),
    enrollment_date=T.DateType(),
    total_cruises=T.IntegerType(),
    lifetime_spend=T.DoubleType(),
    risk_appetite=T.StringType(),
    marital_status=T.StringType(),
    income_bracket=T.StringType(),
)

PLAYS = _struct(
    required=("play_id",),
    play_id=T.LongType(),
    member_id=T.LongType(),
    play_date=T.DateType(),
    ship_name=T.StringType(),
    denomination=PRICE,
    game_name=T.StringType(),
    game_type=T.StringType(),
    num_spins=T.IntegerType(),
    bet_per_spin=PRICE,
    total_wagered=MONEY,
    total_won=MONEY,
    net_result=MONEY,
    session_duration_mins=T.IntegerType(),
    time_of_day=T.StringType(),
)

POLICIES = _struct(
    required=("policy_id",),
    policy_id=T.LongType(),
    category=T.StringType(),
    title=T.StringType(),
    content=T.StringType(),
    last_updated=T.DateType(),
)

MODEL_SUMMARY = _struct(
    model_name=T.StringType(),
    model_type=T.StringType(),
    target=T.StringType(),
    test_size=T.LongType(),
    model_accuracy_pct=T.DoubleType(),
    baseline_accuracy_pct=T.DoubleType(),
    baseline_method=T.StringType(),
    notes=T.StringType(),
)

PORT_PROFILES = _struct(
    ship_name=T.StringType(),
    departure_port=T.StringType(),
    typical_duration=T.IntegerType(),
    denomination_shift=T.DoubleType(),
    port_profile=T.StringType(),
)

MEMBER_ENUMS = {
    "gender": P.GENDERS,
    "membership_tier": P.TIERS,
    "risk_appetite": P.RISKS,
    "marital_status": P.MARITAL,
    "income_bracket": P.INCOMES,
}


def missing_columns(df: DataFrame, schema: T.StructType) -> dict[str, str]:
    """Declared columns that are absent or carry another type (plan-time check)."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    return {
        f.name: f.dataType.simpleString()
        for f in schema.fields
        if actual.get(f.name) != f.dataType
    }


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row. Map-side counts keep hot keys cheap."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys with no parent, with the number of child rows that carry them.

    The child side is reduced to one row per key before it is joined.
    """
    used = child.groupBy(key).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(key).distinct(), key, "left_anti")


def unlisted_values(df: DataFrame, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column_name, value, n_rows) for values outside their declared enumeration."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                for c in enums
            ]
        )
    ).alias("pair")
    listed = F.lit(False)
    for column, values in enums.items():
        hit = (F.col("column_name") == column) & F.coalesce(F.col("value").isin(*values), F.lit(False))
        listed = listed | hit
    return (
        df.select(pairs)
        .select("pair.*")
        .where(~listed)
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n_rows"))
    )
