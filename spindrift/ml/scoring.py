"""Batch scoring: an id or request table goes in, one row per request comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import encode, labels
from spindrift.functions.calendar import with_calendar
from spindrift.ml import estimators as E
from spindrift.ml.store import Model
from spindrift.operators.pick import latest
from spindrift.plans.daily import WIN_RATE_FEATURES
from spindrift.plans.features import FEATURE_COLUMNS
from spindrift.sources import parameters as P


def _or_not_found(text: Column, found: Column) -> Column:
    missing = F.format_string(P.NOT_FOUND_TEXT, F.col("member_id"))
    return F.when(found, text).otherwise(missing)


def score_members(models: dict[str, Model], encoded: DataFrame, ids: DataFrame) -> DataFrame:
    """Preferred denomination and bet category per requested member id, with a sentence.

    ``models`` holds "denomination" and "bet". An unknown id keeps its row.
    """
    known = encoded.join(ids.select("member_id").distinct(), "member_id", "left_semi")
    answers = ids.select("member_id")
    for name in ("denomination", "bet"):
        scored = E.apply(models[name], known, (), FEATURE_COLUMNS, ["member_id"])
        answers = answers.join(scored.select("member_id", F.col("predicted").alias(f"predicted_{name}")), "member_id", "left")
    found = F.col("predicted_denomination").isNotNull()
    price = labels.denomination_label(F.col("predicted_denomination").cast("double"))
    sentence = F.format_string(P.DENOMINATION_TEXT, F.col("member_id"), price)
    bet = F.format_string(P.BET_TEXT, F.col("member_id"), F.col("predicted_bet"))
    return answers.select(
        "*",
        _or_not_found(sentence, found).alias("denomination_text"),
        _or_not_found(bet, found).alias("bet_text"),
    )


def score_members_in_context(
    model: Model,
    members: DataFrame,
    plays: DataFrame,
    ids: DataFrame,
    as_of: str,
    tiebreak: list[str],
    game_type: str,
) -> DataFrame:
    """Denomination for a visit on ``as_of``: newest ship, calendar and demographics.

    Sessions are reduced to one row per requested member before any join.
    """
    wanted = ids.select("member_id").distinct()
    newest = latest(plays.join(wanted, "member_id", "left_semi"), "member_id", "play_date", tiebreak, ["ship_name"])
    context = (
        ids.select("member_id")
        .join(members.withColumn("_known", F.lit(True)), "member_id", "left")
        .join(newest, "member_id", "left")
        .withColumns({"visit": F.lit(as_of).cast("date"), "game_type": F.lit(game_type)})
    )
    rows = with_calendar(context, "visit")
    keep = ["member_id", "_known", "age", "membership_tier", "income_bracket", "risk_appetite"]
    scored = E.apply(model, rows, E.SESSION_CATEGORIES, E.SESSION_NUMBERS, keep)
    text = F.format_string(
        P.CONTEXT_TEXT,
        F.col("member_id"),
        labels.denomination_label(F.col("predicted").cast("double")),
        F.col("age").cast("int"),
        F.col("membership_tier"),
        F.col("income_bracket"),
        F.col("risk_appetite"),
    )
    return scored.select(
        "member_id",
        F.when(F.col("_known"), F.col("predicted")).alias("predicted"),
        _or_not_found(text, F.coalesce(F.col("_known"), F.lit(False))).alias("text"),
    )


def score_what_if(model: Model, requests: DataFrame, key: str) -> DataFrame:
    """Denomination for explicit attributes (one row per request)."""
    return E.apply(model, requests, E.SESSION_CATEGORIES, E.SESSION_NUMBERS, [key])


def ship_day_features(requests: DataFrame, as_of: str, ships: tuple[str, ...] = P.SHIPS) -> DataFrame:
    """Classifier inputs of a planned ship day from ship, weekday, sessions and players.

    What the planner does not state is filled with the documented defaults.
    """
    n = F.col("sessions")
    defaults = P.SHIP_DAY_DEFAULTS
    wagered = n * F.lit(defaults["avg_spins"]) * F.lit(defaults["avg_bet_per_spin"]) * F.lit(P.SHIP_DAY_WAGER_FACTOR)
    return requests.withColumns(
        {
            "ship_encoded": F.coalesce(encode.ordinal(F.col("ship_name"), ships), F.lit(0)),
            "month_num": F.month(F.lit(as_of).cast("date")),
            **{c: F.lit(v) for c, v in defaults.items()},
            "daily_wagered": wagered,
            **{c: F.round(n * F.lit(share)) for c, share in P.SHIP_DAY_SHARES.items()},
        }
    )


def score_ship_days(model: Model, requests: DataFrame, as_of: str) -> DataFrame:
    """Win-rate category per planned ship day (ship_name, dow_sun0, sessions, unique_players)."""
    rows = ship_day_features(requests, as_of)
    scored = E.apply(model, rows, (), WIN_RATE_FEATURES, ["request_id", "ship_name", "dow_sun0", "sessions"])
    text = F.format_string(
        P.SHIP_DAY_TEXT,
        F.col("ship_name"),
        F.col("dow_sun0").cast("int"),
        F.col("sessions").cast("int"),
        F.col("predicted"),
    )
    return scored.select("request_id", "predicted", text.alias("text"))
