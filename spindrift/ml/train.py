"""Train, evaluate and store the models by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import encode
from spindrift.functions.calendar import with_calendar
from spindrift.functions.numeric import uniform
from spindrift.ml import estimators as E
from spindrift.ml import boosting, multi_output, store
from spindrift.operators import evaluation
from spindrift.operators.split import stratified_split
from spindrift.plans import daily, features

NAMES = ("denomination", "registry", "win_rate", "bank", "voyage")


def session_rows(plays: DataFrame, members: DataFrame) -> DataFrame:
    return with_calendar(plays.join(members, "member_id"), "play_date")


def session_sides(rows: DataFrame, key: list[str]) -> DataFrame:
    """What the session model needs of each session, and its side of the stratified split."""
    if "split" in rows.columns:
        return rows
    needed = dict.fromkeys([*key, "denomination", *E.SESSION_CATEGORIES, *E.SESSION_NUMBERS])
    return stratified_split(rows.select(*needed), "denomination", key)


def session_fit(rows: DataFrame, key: list[str], trees: E.Trees = E.FOREST) -> store.Model:
    """Session-level forest on the stratified training rows."""
    train_rows = stratified_split(rows, "denomination", key).where("split = 'TRAIN'")
    return E.fit_classifier(train_rows, "denomination", E.SESSION_CATEGORIES, E.SESSION_NUMBERS, trees, numeric_label=True)


def session_test(model: store.Model, rows: DataFrame, key: list[str]) -> DataFrame:
    """The stratified test rows with their prediction; ``rows`` may have their side already."""
    test = session_sides(rows, key).where("split = 'TEST'")
    return E.apply(model, test, E.SESSION_CATEGORIES, E.SESSION_NUMBERS, [*key, "denomination"])


def member_table(encoded: DataFrame, target: str) -> DataFrame:
    """Member features with the class as ``target``: "denomination" or "bet"."""
    label = F.col("preferred_denomination") if target == "denomination" else encode.bet_category(F.col("avg_bet_per_spin"))
    return encoded.withColumn("target", label.cast("string"))


def member_fit(encoded: DataFrame, target: str, algorithm: str = "boosted", trees: E.Trees | None = None) -> store.Model:
    """Classifier on the member features: a forest, or softmax boosting."""
    view = features.training_view(member_table(encoded, target), F.col("target"), "target")
    if algorithm == "forest":
        return E.fit_classifier(view, "target", (), features.FEATURE_COLUMNS, trees or E.FOREST, target == "denomination")
    return boosting.fit(view, ["target"], (), features.FEATURE_COLUMNS, boosting.SOFTMAX, trees or E.BOOSTED)


def member_test(model: store.Model, encoded: DataFrame, target: str) -> DataFrame:
    test = member_table(encoded, target).where("split = 'TEST'")
    return E.apply(model, test, (), features.FEATURE_COLUMNS, ["member_id", "target"])


def win_rate_fit(training: DataFrame, trees: E.Trees = E.FOREST) -> store.Model:
    return E.fit_classifier(daily.win_rate_view(training), "win_rate_category", (), daily.WIN_RATE_FEATURES, trees)


def win_rate_test(model: store.Model, training: DataFrame) -> DataFrame:
    test = training.where("split = 'TEST'")
    return E.apply(model, test, (), daily.WIN_RATE_FEATURES, ["ship_name", "play_date", "win_rate_category"])


def win_rate_regression_fit(training: DataFrame, trees: E.Trees = E.BOOSTED) -> store.Model:
    rows = training.where("split = 'TRAIN' and win_rate_pct is not null")
    return boosting.fit(rows, ["win_rate_pct"], (), daily.WIN_RATE_FEATURES, trees=trees)


def win_rate_regression_test(model: store.Model, training: DataFrame) -> DataFrame:
    test = training.where("split = 'TEST' and win_rate_pct is not null")
    return E.apply(model, test, (), daily.WIN_RATE_FEATURES, ["ship_name", "play_date", "win_rate_pct"])


def _voyage_side(table: DataFrame) -> DataFrame:
    """Voyages with a seeded draw; a fifth is kept for the test."""
    u = uniform("ship_name", F.col("departure_date").cast("string"), F.col("voyage_duration").cast("string"), salt="42")
    return table.withColumn("u", u)


def voyage_fit(table: DataFrame, trees: E.Trees = E.BOOSTED) -> store.Model:
    """Profit of a voyage from its month, ship, duration and passenger mix."""
    return boosting.fit(_voyage_side(table).where("u < 0.8"), ["total_profit"], ("ship_name",), E.VOYAGE_NUMBERS, trees=trees)


def voyage_test(model: store.Model, table: DataFrame) -> DataFrame:
    keep = ["ship_name", "departure_date", "voyage_duration", "total_profit"]
    return E.apply(model, _voyage_side(table).where("u >= 0.8"), ("ship_name",), E.VOYAGE_NUMBERS, keep)


def train(which: str, tables: Mapping[str, DataFrame], root: str, trees: E.Trees | None = None, version: str = "V1") -> list[str]:
    """Train and store the selected models; ``which`` is one of NAMES or "all".

    ``tables`` must hold the inputs of the selected models: plays, members (with
    ``play_key``), encoded, win_rate, voyages. Returns the stored model names.
    """
    if which not in (*NAMES, "all"):
        raise ValueError(f"unknown model: {which}")
    chosen = NAMES if which == "all" else (which,)
    stored = []

    def keep(name, model, sample, metrics, comment):
        store.save(model, root, name, version, sample.limit(10), metrics, comment)
        stored.append(name)

    def accuracy_of(scored, label):
        row = evaluation.accuracy(evaluation.confusion(scored, label, "predicted")).first()
        return {"accuracy": (row["accuracy_pct"] or 0.0) / 100.0}

    def errors_of(scored, label):
        row = evaluation.regression_metrics(scored, label, "prediction").first()
        return {"mae": row["mae"], "rmse": row["rmse"], "r2": row["r2"]}

    for name in chosen:
        if name == "denomination":
            rows, key = session_rows(tables["plays"], tables["members"]), list(tables["play_key"])
            model = session_fit(rows, key, trees or E.FOREST)
            keep("session_denomination", model, rows, accuracy_of(session_test(model, rows, key), "denomination"), "forest on session context")
        elif name == "registry":
            for target in ("denomination", "bet"):
                model = member_fit(tables["encoded"], target, "boosted", trees)
                keep(f"member_{target}", model, tables["encoded"], accuracy_of(member_test(model, tables["encoded"], target), "target"), "boosted trees")
        elif name == "win_rate":
            model = win_rate_fit(tables["win_rate"], trees or E.FOREST)
            keep("ship_win_rate", model, tables["win_rate"], accuracy_of(win_rate_test(model, tables["win_rate"]), "win_rate_category"), "forest")
        elif name == "bank":
            rows = multi_output.monthly_demand(tables["plays"], tables["members"])
            keep("bank_demand", multi_output.fit(rows, trees or E.DEMAND_BOOSTED), rows, {}, "demand shares of all denominations")
        else:
            model = voyage_fit(tables["voyages"], trees or E.BOOSTED)
            keep("voyage_profit", model, tables["voyages"], errors_of(voyage_test(model, tables["voyages"]), "total_profit"), "boosted trees")
    return stored
