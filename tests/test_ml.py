import pytest
from pyspark.sql import functions as F

from spindrift.ml import boosting
from spindrift.ml import estimators as E
from spindrift.ml import scoring, store
from spindrift.operators import evaluation


@pytest.fixture(scope="module")
def planted(spark):
    """The class depends on the tier and on x."""
    base = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "Gold").otherwise("Basic").alias("tier"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("x"),
    )
    label = F.when(F.col("tier") == "Gold", "100.0").when(F.col("x") > 5, "20.0").otherwise("0.01")
    return base.withColumn("y", label).withColumn("z", F.col("x") * 3 + F.when(F.col("tier") == "Gold", 5).otherwise(0)).cache()


@pytest.fixture(scope="module")
def forest(planted):
    return E.fit_classifier(planted.where("id < 450"), "y", ("tier",), ("x",), E.Trees(5, 4), numeric_label=True)


def test_labels_are_ordered_as_numbers(forest):
    assert E.labels_of(forest) == ["0.01", "20.0", "100.0"]


@pytest.mark.parametrize("algorithm", ["forest", "boosted"])
def test_beats_the_majority_class(planted, algorithm):
    train, test = planted.where("id < 450"), planted.where("id >= 450")
    if algorithm == "forest":
        model = E.fit_classifier(train, "y", ("tier",), ("x",), E.Trees(4, 3))
    else:
        model = boosting.fit(train, ["y"], ("tier",), ("x",), boosting.SOFTMAX, E.Trees(4, 3, 0.5))
    scored = E.apply(model, test, ("tier",), ("x",), ["id", "y"])
    ours = evaluation.accuracy(evaluation.confusion(scored, "y", "predicted")).first()["accuracy_pct"]
    base = evaluation.majority_baseline(train, test, "y").first()["baseline_accuracy_pct"]
    assert ours > 95 and base < 60


def test_same_seed_same_result_and_stored_round_trip(spark, planted, forest, tmp_path):
    again = E.fit_classifier(planted.where("id < 450"), "y", ("tier",), ("x",), E.Trees(5, 4), numeric_label=True)
    score = lambda m: E.apply(m, planted, ("tier",), ("x",), ["id"]).select("id", "predicted")
    assert score(forest).exceptAll(score(again)).count() == 0
    root = str(tmp_path)
    store.save(forest, root, "demo", "V1", planted.limit(3), {"accuracy": 0.9}, "first")
    store.save(forest, root, "demo", "V1", planted.limit(3), {"accuracy": 0.95}, "again")
    assert score(store.load(root, "demo", "V1")).exceptAll(score(forest)).count() == 0
    listed = store.versions(spark, root).collect()
    assert [(r["name"], r["version"], r["metrics"]["accuracy"]) for r in listed] == [("demo", "V1", 0.95)]


def test_unseen_category_is_scored(spark, forest):
    odd = spark.createDataFrame([(1, "Diamond", None)], "id long, tier string, x double")
    row = E.apply(forest, odd, ("tier",), ("x",), ["id"]).first()
    assert row["predicted"] in ("0.01", "20.0", "100.0")


def test_probabilities_sum_to_one(planted, forest):
    scored = E.apply(forest, planted, ("tier",), ("x",), ["id"])
    sums = E.probabilities(scored, "id", E.labels_of(forest)).groupBy("id").agg(F.sum("probability").alias("s"), F.count("*").alias("n"))
    assert sums.where("abs(s - 1) > 1e-9 or n <> 3").count() == 0


def test_importance_and_regression(planted, forest):
    ranked = E.importance(forest).collect()
    assert {r["feature"] for r in ranked} == {"tier_code", "x"} and sum(r["score"] for r in ranked) == pytest.approx(1)
    model = boosting.fit(planted.where("id < 450"), ["z"], ("tier",), ("x",), trees=E.Trees(10, 4, 0.3))
    scored = E.apply(model, planted.where("id >= 450"), ("tier",), ("x",), ["id", "z"])
    assert evaluation.regression_metrics(scored, "z", "prediction").first()["r2"] > 0.9


def test_unknown_member_is_reported(spark, rows):
    encoded = spark.createDataFrame([(i, float(i)) for i in range(40)], "member_id long, v double")
    from spindrift.plans.features import FEATURE_COLUMNS

    table = encoded.select("member_id", *[F.col("v").alias(c) for c in FEATURE_COLUMNS], F.when(F.col("v") > 20, "5.0").otherwise("1.0").alias("y"))
    model = E.fit_classifier(table, "y", (), FEATURE_COLUMNS, E.Trees(3, 3))
    ids = spark.createDataFrame([(3,), (777,)], "member_id long")
    got = {r["member_id"]: r for r in scoring.score_members({"denomination": model, "bet": model}, table, ids).collect()}
    assert got[3]["denomination_text"] == "Predicted preferred denomination for member 3: $1.00"
    assert got[777]["bet_text"] == "Member 777 not found"


def test_ship_day_defaults(spark):
    requests = spark.createDataFrame([("r", "Ship C", 6, 150, 80)], "request_id string, ship_name string, dow_sun0 int, sessions long, unique_players long")
    row = scoring.ship_day_features(requests, "2024-05-01").first()
    assert (row["ship_encoded"], row["month_num"], row["night_sessions"], row["evening_sessions"], row["progressive_sessions"]) == (2, 5, 45.0, 56.0, 38.0)
    assert row["daily_wagered"] == pytest.approx(150 * 250 * 4.2 * 0.5)


def test_categories_with_many_values(spark):
    rows = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 90).alias("code"), (F.col("id") % 90).cast("double").alias("z"))
    model = boosting.fit(rows, ["z"], ("code",), (), trees=E.Trees(1, 2))
    assert E.apply(model, rows, ("code",), (), ["z"]).count() == 400
    forest = E.fit_classifier(rows.withColumn("z", F.col("z").cast("string")), "z", ("code",), (), E.Trees(1, 2))
    assert E.apply(forest, rows, ("code",), (), ["z"]).count() == 400
