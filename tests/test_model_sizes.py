"""The registered model queries fit ensembles of the documented sizes, once per training input."""

from dataclasses import replace

import pytest

import __spark_entry__ as entry_module
from spindrift.ml import boosting, store
from spindrift.ml import estimators as E
from spindrift.registry import models as registry
from spindrift.sources import tables, workdir

SF = "/root/testdata/sf0.001"
FORESTS = ("ml06_forest_session_denomination", "ml08_win_rate_classifier", "ml14_feature_importance", "top05_important_features", "ml15_test_predictions", "ml16_class_probabilities", "ml17_score_members", "ml18_score_members_in_context", "ml19_what_if", "ml20_score_ship_days", "snk09_model_versions")
BOOSTED = ("ml07_boosted_bet_category", "ml09_voyage_profit_regression", "ml10_win_rate_regression")
SIZES = dict.fromkeys(FORESTS, E.FOREST) | dict.fromkeys(BOOSTED, E.BOOSTED) | dict.fromkeys(("ml11_demand_shares", "ml12_leave_one_ship_out"), E.DEMAND_BOOSTED)


class Fitted(Exception):
    """Raised in place of a fit, with the size that was asked for."""


@pytest.mark.parametrize("name", sorted(SIZES))
def test_ensembles_have_the_documented_size(spark, monkeypatch, tmp_path, name):
    def forest(train, label, categories=(), numbers=(), trees=E.FOREST, numeric_label=False):
        raise Fitted(trees)

    def boosted(train, targets, categories=(), numbers=(), kind="squared", trees=E.Trees(), group=None, bins=64):
        raise Fitted(trees)

    monkeypatch.setattr(E, "fit_classifier", forest)
    monkeypatch.setattr(boosting, "fit", boosted)
    monkeypatch.setattr(store, "shared_root", lambda spark: str(tmp_path))
    with pytest.raises(Fitted) as asked:
        entry_module.queries()[name](spark, SF)
    assert replace(asked.value.args[0], seed=42) == SIZES[name]


@pytest.mark.parametrize("name, models", [("ml15_test_predictions", 1), ("ml16_class_probabilities", 1), ("ml17_score_members", 2)])
def test_members_are_encoded_and_read_once_for_all_models(spark, monkeypatch, name, models):
    """All fits and scores of a query share one stored table of members, and two models share the marks of their inputs."""
    written, asked = [], []
    materialise = workdir.materialise

    def stored(df, label):
        written.append(label)
        return materialise(df, label)

    def fitted(spark, name, inputs, settings, fit, root=None):
        asked.append((name, inputs, fit().sample))
        raise Fitted if len(asked) == models else Again

    class Again(Exception):
        pass

    def member_model(*args, call=registry.member_model):
        try:
            return call(*args)
        except Again:
            return None

    monkeypatch.setattr(workdir, "materialise", stored)
    monkeypatch.setattr(registry.train, "member_fit", lambda *args: None)
    monkeypatch.setattr(store, "fitted", fitted)
    monkeypatch.setattr(registry, "member_model", member_model)
    with pytest.raises(Fitted):
        entry_module.queries()[name](spark, SF)
    assert written == ["encoded"]
    assert len({id(rows) for _, _, rows in asked}) == 1
    if models > 1:
        assert all(isinstance(mark, str) for _, inputs, _ in asked for mark in inputs)


@pytest.mark.parametrize("name", ["ml06_forest_session_denomination", "ml18_score_members_in_context", "ml19_what_if"])
def test_sessions_are_joined_once_for_marks_and_scores(spark, monkeypatch, name):
    """The join of the sessions is stored; a query that finds its model reads them from there."""
    joined = []
    plays = tables.plays

    def fitted(spark, name, inputs, settings, fit, root=None):
        assert all(isinstance(mark, str) for mark in inputs)
        return None

    def apply(model, df, categories, numbers, keep):
        raise Fitted(len(joined))

    monkeypatch.setattr(tables, "plays", lambda *args, **more: joined.append(1) or plays(*args, **more))
    monkeypatch.setattr(store, "fitted", fitted)
    monkeypatch.setattr(E, "apply", apply)
    with pytest.raises(Fitted) as asked:
        entry_module.queries()[name](spark, SF)
    assert asked.value.args[0] == 1
