"""Stored models: what readers see when writers fail, repeat or train on other rows."""

import pytest

from spindrift.ml import boosting as B
from spindrift.ml import store


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 7), float(i % 7 > 3)) for i in range(60)], "id long, x double, y double").cache()


def model(rows, rounds=2):
    return B.fit(rows, ["y"], (), ("x",), trees=B.Trees(rounds, 2, 1.0))


def scores(m, rows):
    return [r.s for r in B.predict(m, rows, "s").orderBy("id").collect()]


def test_a_failure_before_the_manifest_publishes_nothing(spark, rows, tmp_path, monkeypatch):
    root, good = str(tmp_path), model(rows)
    store.save(good, root, "demo", "V1", rows, {"r2": 0.5}, "first")

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "_write_manifest", fail)
    with pytest.raises(OSError):
        store.save(model(rows, 1), root, "demo", "V1", rows, {"r2": 0.9}, "second")
    monkeypatch.undo()
    assert [(r["comment"], r["metrics"]) for r in store.versions(spark, root).collect()] == [("first", {"r2": 0.5})]
    assert scores(store.load(root, "demo", "V1"), rows) == scores(good, rows)
    (tmp_path / "manifests" / "_half.json").write_text('{"name": "demo"')
    assert store.versions(spark, root).count() == 1


def test_a_second_save_is_a_new_folder(spark, rows, tmp_path):
    root = str(tmp_path)
    store.save(model(rows, 1), root, "demo", "V1", rows)
    store.save(model(rows, 3), root, "demo", "V1", rows, comment="again")
    store.save(model(rows, 1), root, "demo", "V2", rows)
    assert sorted((r["version"], r["comment"]) for r in store.versions(spark, root).collect()) == [("V1", "again"), ("V2", "")]
    assert len(list((tmp_path / "models" / "demo").iterdir())) == 3
    assert len(store.load(root, "demo", "V1").nodes) == 3
    with pytest.raises(LookupError):
        store.load(root, "demo", "V9")


def test_models_are_found_by_their_training_rows(spark, rows, tmp_path):
    root, asked = str(tmp_path), []

    def fit():
        asked.append(1)
        return store.Fit(model(rows), rows)

    for df in (rows, rows.repartition(3), rows.where("id < 59"), rows):
        store.fitted(spark, "demo", [df], "size 2", fit, root)
    assert len(asked) == 2
    store.fitted(spark, "demo", [rows], "size 3", fit, root)
    store.fitted(spark, "other", [rows], "size 2", fit, root)
    store.fitted(spark, "demo", [rows.union(rows.limit(1))], "size 2", fit, root)
    assert len(asked) == 5
