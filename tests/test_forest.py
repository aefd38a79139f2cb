"""The forest does not depend on where its subtrees grow, and a single tree equals a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.ml import forest
from spindrift.ml.boosting import Trees


@pytest.fixture(scope="module")
def stored(spark):
    base = spark.range(3000).select(
        F.xxhash64("id").alias("draw"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(12))).alias("wide"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 1).cast("int")).alias("short"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(40)).cast("double")).alias("x"),
        F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1000)).cast("double").alias("u"),
    )
    score = F.col("x") + F.when(F.col("wide").isin("c1", "c5", "c9"), 20).otherwise(0) + F.when(F.col("short") == "a", 9).otherwise(0) + F.col("u") / 200
    y = F.when(score > 45, "z").when(score > 25, "y").when(score.isNull() & (F.col("u") < 100), None).otherwise("x")
    return base.withColumn("label", y).cache()


WIDE = [f"c{i}" for i in sorted(range(12), key=str)]


def fitted(stored, trees, local_rows=None):
    return forest.fit(stored, "label", ["x", "y", "z"], ("wide", "short"), (WIDE, ["a", "b"]), ("x", "u"), trees, local_rows=local_rows)


@pytest.mark.parametrize("local_rows", [40, 700])
def test_subtrees_are_the_same_wherever_they_grow(stored, local_rows):
    whole, parts = (fitted(stored, Trees(6, 9, min_rows=2), n) for n in (10**6, local_rows))
    for a, b in zip(whole.trees, parts.trees, strict=True):
        for one, other in zip(a, b, strict=True):
            assert np.array_equal(one, other)
    assert parts.gain == pytest.approx(whole.gain)


def test_partitions_change_nothing(stored):
    a, b = (fitted(df, Trees(3, 6, min_rows=2), 300) for df in (stored, stored.repartition(7)))
    assert all(np.array_equal(one, other) for s, t in zip(a.trees, b.trees, strict=True) for one, other in zip(s, t, strict=True))


def brute_force(x, y, w, category, depth, least, level=0):
    """Class weights of the leaf of every row, by trying every split of every feature; siblings of one class are merged."""
    whole = np.bincount(y, weights=w, minlength=3)
    out = np.tile(whole, (len(y), 1))
    if level == depth or (whole > 0).sum() < 2 or whole.sum() < 2 * least:
        return out, True

    def worth(c):
        return (c * c).sum() / max(c.sum(), 1)

    best, goes = 1e-12 * max(1.0, whole.sum()), None
    for f in range(x.shape[1]):
        codes = np.arange(x[:, f].max() + 1)
        if category[f]:
            held = [np.bincount(y[x[:, f] == c], weights=w[x[:, f] == c], minlength=3) for c in codes]
            codes = np.array(sorted(codes, key=lambda c: (1 - worth(held[c]) / held[c].sum() if held[c].sum() else np.inf, c)))
        for k in range(1, len(codes)):
            left = np.isin(x[:, f], codes[:k])
            a = np.bincount(y[left], weights=w[left], minlength=3)
            gain = worth(a) + worth(whole - a) - worth(whole)
            if a.sum() >= least and (whole - a).sum() >= least and gain > best:
                best, goes = gain, left
    if goes is None:
        return out, True
    sides = [brute_force(x[s], y[s], w[s], category, depth, least, level + 1) for s in (goes, ~goes)]
    if all(leaf for _, leaf in sides) and len({int(v[0].argmax()) for v, _ in sides}) == 1:
        return out, True
    for s, (v, _) in zip((goes, ~goes), sides, strict=True):
        out[s] = v
    return out, False


def test_a_tree_equals_a_plain_loop(stored):
    rows = stored.where("label is not null").orderBy("draw")
    model = forest.fit(stored, "label", ["x", "y", "z"], ("wide",), (WIDE,), ("x",), Trees(1, 5, min_rows=3), local_rows=500)
    held = rows.collect()
    x = np.array([[WIDE.index(r["wide"]), np.searchsorted(model.edges[1], r["x"] or 0.0)] for r in held])
    y = np.array(["xyz".index(r["label"]) for r in held])
    plan = forest._Plan((13, len(model.edges[1]) + 1), np.array([True, False]), 3, 2, Trees(1, 5, min_rows=3))
    w = forest._weights(plan, np.array([r["draw"] for r in held]).view(np.uint64), 0)
    drawn = w > 0
    leaves, _ = brute_force(x[drawn], y[drawn], w[drawn].astype(float), (True, False), 5, 3)
    got = np.array([r["p"] for r in forest.predict(model, rows, "p").orderBy("draw").collect()])[drawn]
    assert np.allclose(got, leaves / leaves.sum(axis=1, keepdims=True))


def test_weights_are_those_of_a_bootstrap():
    plan = forest._Plan((2,), np.array([False]), 2, 1, Trees())
    w = forest._weights(plan, np.arange(200_000, dtype=np.uint64), 3)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - 0.3679) < 0.01


def test_only_node_histograms_of_large_nodes_move(stored):
    """MLlib summed a histogram of every node; here nodes of ``local_rows`` rows at most never become one."""
    with pytest.MonkeyPatch.context() as patch:
        seen = []
        plain = forest._best_top
        patch.setattr(forest, "_best_top", lambda plan, sent: seen.append(sum(map(len, sent.value[1].values()))) or plain(plan, sent))
        fitted(stored, Trees(4, 9, min_rows=2), 1000)
    assert 0 < len(seen) < 9 and max(seen) <= 4 * 3


def test_a_category_without_values_and_rows_without_class(spark):
    rows = spark.createDataFrame([(i, None, float(i % 5), None if i % 7 == 0 else str(i % 5 > 2)) for i in range(90)], "draw long, c string, x double, label string")
    model = forest.fit(rows, "label", ["False", "True"], ("c",), ([],), ("x",), Trees(5, 4))
    got = forest.predict(model, rows, "p").collect()
    assert all(sum(r["p"]) == pytest.approx(1) for r in got) and np.mean([(r["p"][1] > 0.5) == (r["x"] > 2) for r in got]) > 0.95
    with pytest.raises(ValueError):
        forest.fit(rows.where("label is null"), "label", ["False"], (), (), ("x",), Trees(1, 1))


def test_small_nodes_look_at_the_bins_that_hold_rows(monkeypatch):
    """A level of many small nodes costs its rows, not nodes x bins; empty bins change no split."""
    rng = np.random.default_rng(4)
    plan = forest._Plan((150, 200, 6), np.array([True, False, True]), 3, 3, Trees(1, 10, min_rows=2))
    x = np.stack([rng.integers(0, w, 4000) for w in plan.widths]).astype(np.uint8)
    y, w = rng.integers(0, 3, 4000), np.ones(4000, dtype=np.uint8)
    seen, plain = [], forest._best_cut

    def cut(plan, f, cells, sums, whole):
        found = plain(plan, f, cells, sums, whole)
        seen.append((len(cells), int(sums.sum())))
        full = np.zeros((len(whole) * plan.widths[f], plan.classes))
        full[cells] = sums
        every = plain(plan, f, np.arange(len(full)), full, whole)
        real = np.isfinite(found[0])
        assert np.array_equal(found[0], every[0]) and all(np.array_equal(a[real], b[real]) for a, b in zip(found[1:], every[1:], strict=True))
        return found

    monkeypatch.setattr(forest, "_best_cut", cut)
    forest._grow(plan, 0, 0, x, y, w)
    assert len(seen) > 10 and all(cells <= rows for cells, rows in seen)


def test_turns_change_nothing_about_a_subtree(monkeypatch):
    """Growing a few nodes at a time to the bottom gives the nodes that growing level by level gives."""
    rng = np.random.default_rng(5)
    widths = (5, 12, 9, 40)
    plan = forest._Plan(widths, np.array([True, True, False, False]), 3, 2, Trees(1, 8, min_rows=2, seed=4))
    x = np.stack([rng.integers(0, w, 3000) for w in widths]).astype(np.uint8)
    y = (x[0] + x[3] // 9 + rng.integers(0, 2, 3000)) % 3
    w = rng.integers(1, 4, 3000).astype(np.uint8)
    grown = []
    for turn, dense in ((1 << 17, 4), (64, 4), (1, 1 << 40), (1 << 17, 0)):
        monkeypatch.setattr(forest, "TURN", turn)
        monkeypatch.setattr(forest, "DENSE", dense)
        grown.append(forest._grow(plan, 0, 0, x, y, w))
    assert len(grown[0][0]) > 50
    for parts in grown[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(parts[:-1], grown[0][:-1], strict=True))
        assert np.allclose(parts[-1], grown[0][-1])


def test_no_row_is_shuffled_for_a_tree(stored, monkeypatch):
    """Subtrees grow from the stored table, a job a task; a table too large for that deals its rows and gets the same trees."""
    asked, plain = [], forest._grow_read
    monkeypatch.setattr(forest, "_grow_read", lambda plan, sent: asked.append(sent.value[1]) or plain(plan, sent))
    read = fitted(stored, Trees(4, 8, min_rows=2), 600)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 1000)
    small = fitted(stored, Trees(4, 8, min_rows=2), 600)
    monkeypatch.setattr(forest, "READS", 0)
    dealt = fitted(stored, Trees(4, 8, min_rows=2), 600)
    assert len(asked) == 2 and len(asked[1]) >= 8
    for other in (small, dealt):
        assert all(np.array_equal(one, two) for s, t in zip(read.trees, other.trees, strict=True) for one, two in zip(s, t, strict=True))


@pytest.mark.parametrize("turn", [10**6, 500])
def test_large_nodes_are_read_turn_by_turn(monkeypatch, turn):
    """Records of numbers of two bytes, and nodes of more rows than a turn."""
    rng = np.random.default_rng(6)
    widths = (300, 12, 20)
    plan = forest._Plan(widths, np.array([True, True, False]), 3, 3, Trees(1, 4, min_rows=2))
    x = np.stack([rng.integers(0, w, 4000) for w in widths])
    y, w = (x[0] // 60 + x[1] // 4 + x[2] // 8 + rng.integers(0, 2, 4000)) % 3, rng.integers(1, 4, 4000)
    monkeypatch.setattr(forest, "TURN", turn)
    *parts, saved = forest._grow(plan, 0, 0, x, y, w)
    tree = forest._tree(plan, *parts)
    model = forest.Forest(("a", "b", "c"), {}, [], ("0", "1", "2"), saved, [tree])
    votes = forest._votes(model, [forest._steps(tree, widths, plan.category)], x.T.astype(np.uint16))
    want, _ = brute_force(x.T, y, w.astype(float), plan.category, 4, 2)
    assert plan.kind == np.uint16 and len(tree.feature) > 9
    assert np.allclose(votes, want / want.sum(axis=1, keepdims=True))
