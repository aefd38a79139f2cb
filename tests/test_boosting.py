"""Histogram boosting against plain loops over rows and thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.ml import boosting as B
from spindrift.ml.estimators import Trees

N = 240


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (N, 2)).astype(float)
    ship = rng.choice(["a", "b", "c"], N)
    y = np.column_stack([x[:, 0] * 2 + (ship == "b") * 7, (x[:, 1] > 4) * 5.0 - x[:, 0]]) + rng.normal(0, 0.1, (N, 2))
    kind = np.where(x[:, 0] > 6, "high", np.where(x[:, 1] > 4, "mid", "low"))
    rows = [(i, ship[i], float(x[i, 0]), float(x[i, 1]), float(y[i, 0]), float(y[i, 1]), kind[i]) for i in range(N)]
    df = spark.createDataFrame(rows, "id int, ship string, u double, v double, p double, q double, kind string").repartition(3).cache()
    return df, np.column_stack([np.searchsorted(["a", "b", "c"], ship), x]), y, kind


def tree(x, grad, depth, leaf, min_rows=1):
    """Plain regression tree: a function from rows to leaf values."""
    best = None
    if depth:
        whole = (grad.sum(axis=0) ** 2).sum() / len(grad)
        for f in range(x.shape[1]):
            for t in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= t
                if min(left.sum(), (~left).sum()) < min_rows:
                    continue
                gain = sum((grad[side].sum(axis=0) ** 2).sum() / side.sum() for side in (left, ~left)) - whole
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, t)
    if best is None:
        value = leaf(grad)
        return lambda z: np.repeat(value[None, :], len(z), axis=0)
    _, f, t = best
    left = x[:, f] <= t
    low, high = (tree(x[s], grad[s], depth - 1, leaf, min_rows) for s in (left, ~left))
    return lambda z: np.where((z[:, f] <= t)[:, None], low(z), high(z))


def boosted(x, y, rounds, depth, step):
    state, trees = np.repeat(y.mean(axis=0)[None, :], len(y), axis=0), []
    for _ in range(rounds):
        trees.append(tree(x, y - state, depth, lambda g: step * g.mean(axis=0)))
        state = state + trees[-1](x)
    return lambda z: y.mean(axis=0) + sum(t(z) for t in trees)


def test_one_small_tree_and_the_leaves_of_all_targets(data):
    df, x, y, _ = data
    model = B.fit(df, ["p", "q"], ("ship",), ("u", "v"), trees=Trees(1, 2, 1.0))
    got = {r.id: r.scores for r in B.predict(model, df).collect()}
    want = boosted(x, y, 1, 2, 1.0)(x)
    assert np.allclose([got[i] for i in range(N)], want)


def test_rounds_folds_and_rewritten_predictions(data, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 2)
    df, x, y, _ = data
    model = B.fit(df, ["p", "q"], (), ("u", "v"), trees=Trees(5, 2, 0.3), group="ship")
    assert model.folds == ("", "a", "b", "c")
    got = {r.id: r.scores for r in B.predict(model, df, fold=F.col("ship")).collect()}
    for code in range(3):
        held = x[:, 0] == code
        want = boosted(x[~held][:, 1:], y[~held], 5, 2, 0.3)(x[held][:, 1:])
        assert np.allclose([got[i] for i in np.flatnonzero(held)], want)
    whole = {r.id: r.scores for r in B.predict(model, df).collect()}
    assert np.allclose([whole[i] for i in range(N)], boosted(x[:, 1:], y, 5, 2, 0.3)(x[:, 1:]))
    again = B.Boosted.from_bytes(model.to_bytes())
    assert [r.scores for r in B.predict(again, df).orderBy("id").collect()] == [whole[i] for i in range(N)]
    assert sum(model.importance().values()) == pytest.approx(1)


def test_softmax_first_round_equals_plain_trees_and_probabilities_add_up(data):
    df, x, _, kind = data
    classes = ["high", "low", "mid"]
    one = np.array([[k == c for c in classes] for k in kind], dtype=float)
    share = one.mean(axis=0)
    grad = one - share

    def leaf(g):
        return np.array([0.5 * 2 / 3 * g.sum() / max((np.abs(g) * (1 - np.abs(g))).sum(), 1e-12)])

    scores = np.log(share) + np.column_stack([tree(x, grad[:, [c]], 2, leaf)(x)[:, 0] for c in range(3)])
    model = B.fit(df, ["kind"], ("ship",), ("u", "v"), B.SOFTMAX, Trees(1, 2, 0.5))
    got = {r.id: r.scores for r in B.predict(model, df).collect()}
    assert model.outputs == tuple(classes)
    assert np.allclose([got[i] for i in range(N)], np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True))
    strong = B.fit(df, ["kind"], ("ship",), ("u", "v"), B.SOFTMAX, Trees(12, 2, 0.5))
    rows = B.predict(strong, df).collect()
    assert all(abs(sum(r.scores) - 1) < 1e-12 for r in rows)
    assert np.mean([classes[int(np.argmax(r.scores))] == r.kind for r in rows]) > 0.98


def test_odd_inputs(spark, data):
    df, *_ = data
    model = B.fit(df.withColumn("u", F.when(F.col("u") > 0, F.col("u"))), ["p"], ("ship",), ("u",), trees=Trees(2, 2))
    odd = spark.createDataFrame([("new", None, 1), (None, 3.0, 2)], "ship string, u double, scores int")
    assert B.predict(model, odd, "s").where("size(s) = 1").count() == 2
    flat = B.fit(df.withColumn("p", F.lit(3.0)), ["p"], (), ("u",), trees=Trees(2, 2))
    assert {r.s[0] for r in B.predict(flat, odd, "s").collect()} == {3.0}
    assert B.predict(model, odd.limit(0), "s").count() == 0
    with pytest.raises(ValueError):
        B.fit(df, ["p", "q"], kind=B.SOFTMAX)


@pytest.mark.parametrize("kind", [B.SQUARED, B.SOFTMAX])
def test_one_job_and_a_job_a_level_grow_the_same_trees(data, monkeypatch, kind):
    df = data[0]
    targets, group = (["p", "q"], "ship") if kind == B.SQUARED else (["kind"], None)
    jobs = []
    plain = B._histograms
    monkeypatch.setattr(B, "_histograms", lambda *a: jobs.append(a[4]) or plain(*a))
    small = B.fit(df, targets, ("ship",), ("u", "v"), kind, Trees(5, 3, 0.3), group)
    assert not jobs
    monkeypatch.setattr(B, "LOCAL_ROWS", 0)
    large = B.fit(df, targets, ("ship",), ("u", "v"), kind, Trees(5, 3, 0.3), group)
    assert len(jobs) == 15 and len(small.nodes) == len(large.nodes) == 5
    for one, other in zip(small.nodes, large.nodes, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(one, other, strict=True))
    assert np.allclose(small.gain, large.gain)


@pytest.mark.parametrize("kind", [B.SQUARED, B.SOFTMAX])
def test_rows_are_stored_in_blocks(data, monkeypatch, kind):
    """A stored row is a block of rows, in the first table and after predictions are written anew; blocks change no tree."""
    df, held, rows = data[0], [], []
    targets, group = (["p", "q"], "ship") if kind == B.SQUARED else (["kind"], None)
    materialise = B.workdir.materialise
    monkeypatch.setattr(B.workdir, "materialise", lambda frame, label: held.append(materialise(frame, label)) or held[-1])
    monkeypatch.setattr(B, "LOCAL_ROWS", 0)
    whole = B.fit(df, targets, ("ship",), ("u", "v"), kind, Trees(4, 2, 0.3), group)
    rows = [t.count() for t in held]
    monkeypatch.setattr(B, "BLOCK", 50)
    parts = B.fit(df, targets, ("ship",), ("u", "v"), kind, Trees(4, 2, 0.3), group)
    assert len(rows) == 2 and max(rows) <= df.sparkSession.sparkContext.defaultParallelism
    for one, other in zip(whole.nodes, parts.nodes, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(one, other, strict=True))
