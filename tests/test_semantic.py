from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spindrift.plans import semantic
from spindrift.plans.semantic import MODEL, SemanticError


@pytest.fixture(scope="module")
def frames(spark):
    members = spark.createDataFrame(
        [(1, "M", "Gold", 30, 100.0), (2, "F", "Gold", 50, 300.0), (3, "M", "Basic", 40, 50.0)],
        "member_id long, gender string, membership_tier string, age int, lifetime_spend double",
    ).withColumns(
        {c: F.lit("x") for c in ("home_state", "risk_appetite", "marital_status", "income_bracket")}
        | {"enrollment_date": F.lit(date(2020, 1, 1)), "total_cruises": F.lit(1)}
    )
    data = [(i, m, s, Decimal(d), Decimal(w)) for i, m, s, d, w in
            [(1, 1, "Ship A", "0.01", "10"), (2, 1, "Ship A", "5.00", "20"), (3, 1, "Ship B", "5.00", "30"), (4, 9, "Ship B", "1.00", "40")]]
    plays = spark.createDataFrame(
        data, "play_id long, member_id long, ship_name string, denomination decimal(10,2), total_wagered decimal(18,2)"
    ).withColumns({
        "game_name": F.lit("g"), "game_type": F.lit("t"), "time_of_day": F.lit("Night"), "play_date": F.lit(date(2024, 5, 5)),
        "num_spins": F.lit(1), "bet_per_spin": F.lit(1), "total_won": F.lit(1), "net_result": F.lit(1), "session_duration_mins": F.lit(1)})
    return {"members": members, "plays": plays}


def ask(frames, **request):
    return semantic.compile_request(MODEL, frames, **request)


def test_member_metrics_are_not_multiplied_by_sessions(frames, rows):
    got = rows(ask(frames, metrics=["avg_age", "total_sessions"], dimensions=["tier"]))
    assert got == [("Basic", 40.0, None), ("Gold", 40.0, 3), (None, None, 1)]


def test_fan_out_is_refused(frames):
    with pytest.raises(SemanticError):
        ask(frames, metrics=["total_members"], dimensions=["ship"])
    with pytest.raises(SemanticError):
        ask(frames, metrics=["total_members"], filters=["penny_slots"])


def test_names_synonyms_and_ambiguity():
    assert MODEL.find("Gross Gaming Revenue", "metrics") == ("plays", "total_amount_wagered")
    assert MODEL.find("tier", "dimensions") == ("members", "membership_tier")
    assert MODEL.find("features.gender", "dimensions") == ("features", "gender")
    with pytest.raises(SemanticError):
        MODEL.find("gender", "dimensions")
    with pytest.raises(SemanticError):
        MODEL.find("nonsense", "metrics")


def test_filters_on_both_sides(frames, rows):
    got = ask(frames, metrics=["session count", "unique_players"], dimensions=["ship"], filters=["high_denomination", ("tier", "Gold")])
    assert rows(got) == [("Ship A", 1, 1), ("Ship B", 1, 1)]


def test_grain_order_limit_and_rounding(frames):
    got = ask(frames, metrics=["total revenue", "avg_bet"], dimensions=["session date"], grain="month",
              order_by=["-total_amount_wagered"], limit=1, digits={"avg_bet": 1}).collect()
    assert [tuple(r) for r in got] == [(date(2024, 5, 1), 100.0, 1.0)]


def test_no_dimension_is_one_row(frames, rows):
    assert rows(ask(frames, metrics=["total_members", "unique_players"])) == [(3, 2)]


def test_enum_violations_and_validation(spark, frames, rows):
    assert ("risk_appetite", "x", 3) in rows(semantic.enum_violations(MODEL, frames, "members"))
    small = semantic.Model({k: MODEL.tables[k] for k in ("members", "plays")}, MODEL.relationships[:1])
    with pytest.raises(Exception):
        small.validate({"members": frames["members"].drop("age"), "plays": frames["plays"]})


@pytest.fixture(scope="module")
def three(spark, frames):
    features = spark.createDataFrame([(1, "slots", "Ship A"), (2, "slots", "Ship B"), (3, "poker", "Ship B")], "member_id long, preferred_game_type string, most_played_ship string")
    return {**frames, "features": features}


def test_two_relationships_away(three, rows):
    got = rows(ask(three, metrics=["plays.total_sessions", "unique_players"], dimensions=["preferred_game_type"]))
    assert got == [("slots", 3, 1), (None, 1, 1)]
    got = rows(ask(three, metrics=["plays.total_sessions"], dimensions=["members.gender", "most_played_ship", "ship"], filters=[("tier", "Gold")]))
    assert got == [("M", "Ship A", "Ship A", 2), ("M", "Ship A", "Ship B", 1)]


def test_fan_out_paths_are_named(three):
    with pytest.raises(SemanticError, match="plays would multiply the rows of features: members -> plays is one to many"):
        ask(three, metrics=["member_count"], dimensions=["game"])
    alone = semantic.Model({**MODEL.tables, "ports": MODEL.tables["members"]}, MODEL.relationships)
    with pytest.raises(SemanticError, match="no relationship leads there"):
        alone.path("plays", "ports")


def test_a_key_must_be_unique_and_a_way_the_only_one():
    tables = {n: semantic.LogicalTable(f"{n}_id", {}, {}) for n in "abcd"}
    edges = [("a", "b", "b_id"), ("a", "c", "c_id"), ("b", "d", "d_id"), ("c", "d", "d_id")]
    both = semantic.Model(tables, tuple(semantic.Relationship(*e) for e in edges))
    with pytest.raises(SemanticError, match="a -> b -> d or a -> c -> d"):
        both.path("a", "d")
    assert both.path("b", "d") == [("b", "d", "d_id")]
    loose = semantic.Model(tables, (semantic.Relationship("a", "b", "name"),))
    with pytest.raises(SemanticError, match="a -> b is one to many"):
        loose.path("a", "b")


def test_data_checks_show_what_was_planted(spark, frames):
    members = frames["members"].unionByName(frames["members"].where("member_id = 1").withColumn("membership_tier", F.lit("Copper")))
    members = members.unionByName(frames["members"].where("member_id = 2").withColumns({"member_id": F.lit(None).cast("long"), "home_state": F.lit(None).cast("string")}))
    found = {(r.column_name, r.check): r.n_rows for r in semantic.data_checks(MODEL, {"members": members}, "members").collect()}
    assert found["member_id", "unique"] == 1 and found["member_id", "present"] == 1
    assert found["membership_tier", "listed"] == 1 and found["home_state", "present"] == 1 and found["gender", "listed"] == 0
    assert found["risk_appetite", "listed"] == 5
    plays = {(r.column_name, r.check): r.n_rows for r in semantic.data_checks(MODEL, frames, "plays").collect()}
    assert plays["play_id", "unique"] == 0 and plays["ship_name", "listed"] == 0
    assert all(r.n_rows == 0 for r in semantic.data_checks(MODEL, {"members": members.limit(0)}, "members").collect())
