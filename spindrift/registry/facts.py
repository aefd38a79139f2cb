"""What must hold of trained models whatever they predict: which rows they answer, once each, that
probabilities and shares add up, which names are stored. Each query runs the model's own result and
reduces it to facts that SQL states from the tables alone; scores themselves are checked in tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.numeric import round_half_up, uniform
from spindrift.ml import estimators as E
from spindrift.ml import multi_output, train
from spindrift.operators import evaluation
from spindrift.operators.split import stratified_split
from spindrift.plans import features
from spindrift.registry import models
from spindrift.registry.base import QUERIES, query, rounded, with_views
from spindrift.registry.marts import DAILY, DAY2_SQL, ENCODED, encoded, win_rate_training
from spindrift.sources import parameters as P
from spindrift.sources import tables, workdir

BET_SQL = """CASE WHEN avg_bet_per_spin <= 2 THEN 'Low' WHEN avg_bet_per_spin <= 4 THEN 'Medium'
  WHEN avg_bet_per_spin <= 7 THEN 'High' ELSE 'VeryHigh' END"""
SESSION_SPLIT = """(SELECT CAST(denomination AS VARCHAR) AS actual, count(*) AS n, count(*) * 80 // 100 AS train_rows FROM plays GROUP BY 1)"""


def _by_class(confusion: DataFrame) -> DataFrame:
    return confusion.groupBy("actual").agg(F.sum("n").alias("test_rows"))


@query("ml06_test_rows_by_class", with_views("plays") + f"SELECT actual, n - train_rows AS test_rows FROM {SESSION_SPLIT}")
def session_rows_by_class(spark, sf):
    return _by_class(QUERIES["ml06_forest_session_denomination"](spark, sf))


@query("ml07_test_rows_by_class", ENCODED + f"SELECT {BET_SQL} AS actual, count(*) AS test_rows FROM encoded WHERE split = 'TEST' GROUP BY 1")
def bet_rows_by_class(spark, sf):
    return _by_class(QUERIES["ml07_boosted_bet_category"](spark, sf))


@query("ml08_test_rows_by_class", DAILY + f"SELECT win_rate_category AS actual, count(*) AS test_rows FROM ({DAY2_SQL}) WHERE split = 'TEST' GROUP BY 1")
def win_rate_rows_by_class(spark, sf):
    return _by_class(QUERIES["ml08_win_rate_classifier"](spark, sf))


@query("ml10_test_rows_by_ship", DAILY + f"SELECT ship_name, count(*) AS n FROM ({DAY2_SQL}) WHERE split = 'TEST' AND win_rate_pct IS NOT NULL GROUP BY 1")
def win_rate_rows_by_ship(spark, sf):
    return QUERIES["ml10_win_rate_regression"](spark, sf).select("ship_name", "n")


_SHIP_MONTHS = with_views("plays") + ", s AS (SELECT DISTINCT ship_name, CAST(date_trunc('month', play_date) AS DATE) AS month FROM plays)"


@query("ml11_shares_add_up", _SHIP_MONTHS + " SELECT ship_name, month, 100.0::DOUBLE AS total FROM s")
def shares_add_up(spark, sf):
    predicted = [F.col(f"predicted_{t}") for t in multi_output.TARGETS]
    total = round_half_up(reduce(lambda a, b: a + b, predicted), 6)
    return QUERIES["ml11_demand_shares"](spark, sf).select("ship_name", "month", total.alias("total"))


_TARGETS_SQL = ", ".join(f"('{t}')" for t in multi_output.TARGETS)


@query("ml12_rows_by_target", _SHIP_MONTHS + f" SELECT target, (SELECT count(*) FROM s) AS n FROM (VALUES {_TARGETS_SQL}) AS t(target)")
def left_out_rows_by_target(spark, sf):
    return QUERIES["ml12_leave_one_ship_out"](spark, sf).select("target", "n")


_FEATURES_SQL = ", ".join(f"('{c}')" for c in features.FEATURE_COLUMNS)


@query("ml14_features", f"SELECT feature, 1.0::DOUBLE AS total FROM (VALUES {_FEATURES_SQL}) AS f(feature) WHERE (SELECT count(*) FROM customer) > 0")
def importance_adds_up(spark, sf):
    """Every input has an importance, and they add up to one."""
    ranked = QUERIES["ml14_feature_importance"](spark, sf)
    total = ranked.agg(round_half_up(F.sum("score"), 9).alias("total"))
    return ranked.select("feature", total.scalar().alias("total"))


@query("ml15_test_members", ENCODED + "SELECT member_id, CAST(preferred_denomination AS VARCHAR) AS target, true AS answered FROM encoded WHERE split = 'TEST'")
def test_members(spark, sf):
    return QUERIES["ml15_test_predictions"](spark, sf).select("member_id", "target", F.col("predicted").isNotNull().alias("answered"))


_CLASSES_SQL = "(SELECT count(DISTINCT {}) FROM encoded WHERE split = 'TRAIN')"


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("member_id").agg(F.count("*").alias("classes"), round_half_up(F.sum("probability"), 9).alias("total"))


@query("ml16_probabilities_add_up", ENCODED + f"SELECT member_id, {_CLASSES_SQL.format('preferred_denomination')} AS classes, 1.0::DOUBLE AS total FROM encoded WHERE split = 'TEST'")
def probabilities_add_up(spark, sf):
    return _sums(QUERIES["ml16_class_probabilities"](spark, sf))


@query("ml16_boosted_probabilities")
def boosted_probabilities(spark, sf):
    model = models.member_model(spark, sf, "bet", "boosted")
    return E.probabilities(train.member_test(model, encoded(spark, sf), "bet"), "member_id", E.labels_of(model))


@query("ml16_boosted_probabilities_add_up", ENCODED + f"SELECT member_id, {_CLASSES_SQL.format(BET_SQL)} AS classes, 1.0::DOUBLE AS total FROM encoded WHERE split = 'TEST'")
def boosted_probabilities_add_up(spark, sf):
    return _sums(boosted_probabilities(spark, sf))


_ASKED = "SELECT DISTINCT user_id AS member_id, user_id IN (SELECT member_id FROM members) AS known FROM events"


def _known(rows: DataFrame, text: str) -> DataFrame:
    missing = F.format_string(P.NOT_FOUND_TEXT, F.col("member_id"))
    return rows.select("member_id", (F.col(text) != missing).alias("known"))


@query("ml17_members_found", with_views("members") + _ASKED)
def members_found(spark, sf):
    return _known(QUERIES["ml17_score_members"](spark, sf), "denomination_text")


@query("ml18_members_found", with_views("members") + _ASKED)
def members_found_in_context(spark, sf):
    return _known(QUERIES["ml18_score_members_in_context"](spark, sf), "text")


@query(
    "ml19_requests_answered",
    with_views("members", "plays")
    + """SELECT DISTINCT concat_ws('|', ship_name, game_type, membership_tier, gender, risk_appetite, income_bracket) AS request_id, true AS answered
      FROM plays JOIN members USING (member_id)""",
)
def requests_answered(spark, sf):
    return QUERIES["ml19_what_if"](spark, sf).select("request_id", F.col("predicted").isNotNull().alias("answered"))


@query("ml20_ship_days_answered", DAILY + "SELECT DISTINCT ship_name || ':' || dow_sun0 AS request_id, true AS answered FROM daily")
def ship_days_answered(spark, sf):
    return QUERIES["ml20_score_ship_days"](spark, sf).select("request_id", F.col("predicted").isNotNull().alias("answered"))


@query("gen01_ranges", with_views("members") + "SELECT member_id, true AS valid FROM members")
def member_ranges(spark, sf):
    """One generated member an id, every attribute within its list or range."""
    rows = QUERIES["gen01_members"](spark, sf)
    listed = F.col("gender").isin(*P.GENDERS) & F.col("membership_tier").isin(*P.TIERS) & F.col("risk_appetite").isin(*P.RISKS) & F.col("marital_status").isin(*P.MARITAL) & F.col("income_bracket").isin(*P.INCOMES)
    within = F.col("age").between(21, 80) & F.col("total_cruises").between(1, 20) & F.col("lifetime_spend").between(1000, 50999)
    return rows.select("member_id", (listed & within).alias("valid"))


@query("gen02_ranges", with_views("plays") + "SELECT true AS valid, count(*) AS n, count(DISTINCT (play_order, play_part, play_machine, play_line)) AS ids FROM plays")
def session_ranges(spark, sf):
    """One generated session an id, members among those there are, money as spins, bet and price say."""
    rows = QUERIES["gen02_sessions"](spark, sf)
    n = tables.members(spark, sf).count()
    listed = F.col("ship_name").isin(*P.SHIPS) & F.col("time_of_day").isin(*P.TIMES_OF_DAY) & F.col("member_id").between(1, n)
    stake = F.round(F.col("num_spins") * F.col("bet_per_spin") * F.col("denomination"), 2)
    money = (F.col("total_wagered") == stake) & (F.col("net_result") == F.col("total_won") - F.col("total_wagered"))
    return rows.groupBy((listed & money).alias("valid")).agg(F.count("*").alias("n"), F.count_distinct("play_id").alias("ids"))


_U = "CAST(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(
    "ml04_rows_chosen",
    with_views("plays")
    + f""", u AS (SELECT *, {_U.format("concat_ws(':', '42', play_order, play_part, play_machine, play_line)")} AS draw FROM plays),
    r AS (SELECT *, row_number() OVER (PARTITION BY denomination ORDER BY draw, play_order, play_part, play_machine, play_line) AS rn,
      count(*) OVER (PARTITION BY denomination) AS n FROM u)
    SELECT play_order, play_part, play_machine, play_line, CASE WHEN rn * 100 <= n * 80 THEN 'TRAIN' ELSE 'TEST' END AS split FROM r""",
)
def stratified_rows(spark, sf):
    """The side of every session in the stratified split."""
    key = list(tables.PLAY_KEY)
    rows = tables.plays(spark, sf, games=False).select("denomination", *key)
    return stratified_split(rows, "denomination", key).select(*key, "split")


@query("ml05_rows_chosen", with_views("members") + f"SELECT member_id, CASE WHEN {_U.format('concat_ws(chr(58), 42, member_id)')} < 0.8 THEN 'TRAIN' ELSE 'TEST' END AS split FROM members")
def random_rows(spark, sf):
    """The side of every member in the seeded random split."""
    u = uniform("member_id", salt="42")
    return tables.members(spark, sf).select("member_id", F.when(u < 0.8, "TRAIN").otherwise("TEST").alias("split"))


# --- evaluation of all models ----------------------------------------------------------------


def _outcomes(name: str, rows: DataFrame, label: str, test: DataFrame | None = None) -> DataFrame:
    """Class and answer of the training and test ``rows``; those of ``test``, if there are answers, take the place of the test rows."""
    none = F.lit(None).cast("string").alias("predicted")
    actual = F.col(label).cast("string").alias("actual")
    chosen = rows.where(F.col("split").isin("TRAIN", "TEST") if test is None else F.col("split") == "TRAIN").select("split", actual, none)
    if test is not None:
        chosen = chosen.unionByName(test.select(F.lit("TEST").alias("split"), actual, F.col("predicted").cast("string").alias("predicted")))
    return chosen.select(F.lit(name).alias("model_name"), "*")


def _all_outcomes(spark, sf, trained: bool) -> DataFrame:
    """Training classes and test outcomes of the four classifiers; without ``trained`` no predictions.

    Sessions are joined and written once; members, ship days and all models read them from there, and
    the outcomes and the scores of the session forest share their split.
    """
    key = list(tables.PLAY_KEY)
    plays = models.sessions_once(spark, sf)
    sessions = train.session_rows(plays, tables.members(spark, sf)) if trained else tables.plays(spark, sf, games=False).select("denomination", *key)
    sides = models.sides_once(spark, sf, plays) if trained else stratified_split(sessions, "denomination", key)
    table, days = encoded(spark, sf, plays), win_rate_training(spark, sf, plays)
    if not trained:
        table, days = table.select("preferred_denomination", "avg_bet_per_spin", "split"), days.select("win_rate_category", "split")
    table, days = workdir.materialise(table, "encoded"), workdir.materialise(days, "win-rate")
    marks = models.input_marks(spark, sf, plays) if trained else None
    test = train.session_test(models.session_model(spark, sf, marks, sessions), sides, key) if trained else None
    parts = [_outcomes("session_denomination", sides, "denomination", test)]
    for target, algorithm in (("denomination", "forest"), ("bet", "boosted")):
        test = train.member_test(models.member_model(spark, sf, target, algorithm, table, marks), table, target) if trained else None
        parts.append(_outcomes(f"member_{target}", train.member_table(table, target), "target", test))
    test = train.win_rate_test(models.win_rate_model(spark, sf, days, marks[:1]), days) if trained else None
    parts.append(_outcomes("ship_win_rate", days, "win_rate_category", test))
    return reduce(DataFrame.unionByName, parts)


@query("agg31_all_models")
def all_models(spark, sf):
    """Accuracy of every trained classifier next to its baseline."""
    return evaluation.evaluate_all(_all_outcomes(spark, sf, trained=True))


@query(
    "agg31_test_sizes_and_baselines",
    ENCODED.rstrip()
    + f""", {DAILY[DAILY.index('daily AS') :].strip()},
    classes AS (SELECT 'session_denomination' AS model_name, actual, train_rows AS train_n, n - train_rows AS test_n FROM {SESSION_SPLIT}
      UNION ALL SELECT 'member_denomination', CAST(preferred_denomination AS VARCHAR), count(*) FILTER (split = 'TRAIN'), count(*) FILTER (split = 'TEST')
        FROM encoded WHERE preferred_denomination IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'member_bet', {BET_SQL}, count(*) FILTER (split = 'TRAIN'), count(*) FILTER (split = 'TEST') FROM encoded GROUP BY 2
      UNION ALL SELECT 'ship_win_rate', win_rate_category, count(*) FILTER (split = 'TRAIN'), count(*) FILTER (split = 'TEST')
        FROM ({DAY2_SQL}) WHERE win_rate_category IS NOT NULL GROUP BY 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY train_n DESC, actual) AS rn FROM classes)
    SELECT model_name, CAST(sum(train_n) AS BIGINT) AS train_size, CAST(sum(test_n) AS BIGINT) AS test_size, max(actual) FILTER (rn = 1) AS baseline_class,
      CAST(sum(test_n) FILTER (rn = 1) AS BIGINT) AS baseline_correct,
      {rounded('sum(test_n) FILTER (rn = 1) * 100.0::DOUBLE / nullif(sum(test_n), 0)', 2)} AS baseline_accuracy_pct
    FROM ranked GROUP BY model_name""",
)
def test_sizes_and_baselines(spark, sf):
    """The same evaluation without the models' answers."""
    columns = ["model_name", "train_size", "test_size", "baseline_class", "baseline_correct", "baseline_accuracy_pct"]
    return evaluation.evaluate_all(_all_outcomes(spark, sf, trained=False)).select(*columns)
