"""Every registered query on the smallest tables, with the shape of its physical plan."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry_module
from spindrift.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# trained in test_ml on small fixtures; too slow to repeat here
SLOW = {"ml12_leave_one_ship_out", "ml11_demand_shares", "ml09_voyage_profit_regression", "ml10_win_rate_regression", "snk09_model_versions"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries()) and set(QUERIES) <= set(entry_module.queries())


def test_entry_returns_the_flagship(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_values_equal_sql_and_plan_has_no_cross_join(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    ok, note = compare(spark, con, lambda *_: df, ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["flt10_between_dates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    point = QUERIES["flt06_point_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,101)" in point and "EqualTo(o_custkey,101)" in point
