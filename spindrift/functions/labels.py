"""Display text assembled on the JVM side (no Python row functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.sources import parameters as P


def denomination_label(denomination: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(denomination.cast("decimal(10,2)"), 2))


def decade(age: Column) -> Column:
    return (F.floor(age / 10) * 10).cast("int")


def decade_label(age: Column) -> Column:
    return F.concat(decade(age).cast("string"), F.lit("s"))


def member_label() -> Column:
    """One-line description of a member for pick lists."""
    return F.format_string(
        P.MEMBER_LABEL,
        F.col("member_id"),
        F.col("gender"),
        F.col("age"),
        F.col("membership_tier"),
        F.col("risk_appetite"),
        F.col("income_bracket"),
    )


def thousands(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def clean_header(name: str) -> str:
    """Normalise a quoted result header, e.g. ``"score"`` -> ``SCORE``."""
    return name.strip('"').upper()


def share_column(denomination: float) -> str:
    """Column name that carries the demand share of one denomination."""
    return "pct_" + f"{float(denomination)}".replace(".", "_")
