"""Boosted trees for many targets, classes and validation folds in one run.

Every level of every tree of a round is one aggregation: tasks add gradients into histograms keyed
by (tree, node, feature, bin), the histograms of a tree are summed in one group, and the best split
of each of its nodes comes back. All folds share the passes, so leaving out each of eight groups
costs as many jobs as one fit.

* ``squared``: one tree a round and fold; its leaves hold a value for every target, and a split is
  worth the loss it saves over all targets.
* ``softmax``: one tree a round and class on the gradients of the multinomial loss, so a row has
  class probabilities that add up to one.

The stored training table holds binned features, targets and the running predictions in blocks of
rows, so a task reads numbers and no value of a single row passes between Spark and Python; every
``REWRITE`` rounds the predictions are written anew, so no job replays more trees than that. The
driver holds trees and split candidates, whose number does not depend on the rows. A table of at
most ``LOCAL_ROWS`` rows, such as ship days, is fitted in one job: a task adds histograms over it as
fast as a thousand jobs are planned.
"""

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches
from spindrift.sources import workdir

# fixed value: split candidates of a number; categories get as many bins as they have values
BINS = 64
SQUARED, SOFTMAX = "squared", "softmax"
REWRITE = 3
#: Rows of a training table (times folds) that one task fits.
LOCAL_ROWS = 1 << 17
#: Rows of a stored block.
BLOCK = 1 << 15


@dataclass(frozen=True)
class Trees:
    """Ensemble size. ``min_rows`` bounds the rows per leaf."""

    rounds: int = 200
    depth: int = 5
    step: float = 0.1
    min_rows: int = 1
    seed: int = 42


@dataclass
class Boosted:
    """A fitted model. ``nodes[r]`` are the split feature (-1: leaf), its bin and the values of round
    r, each by tree and node of a full binary tree; ``start`` are the predictions before any tree."""

    kind: str
    features: tuple[str, ...]
    categories: dict[str, list[str]]
    edges: list[np.ndarray]
    outputs: tuple[str, ...]
    folds: tuple[str, ...]
    start: np.ndarray
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def importance(self) -> dict[str, float]:
        """Share of the loss saved by splits on each feature."""
        total = self.gain.sum()
        return dict(zip(self.features, (self.gain / total if total else self.gain).tolist(), strict=True))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"edges{i}": e for i, e in enumerate(self.edges)}
        for i, name in enumerate(("feature", "bin", "value")):
            arrays[name] = np.stack([n[i] for n in self.nodes]) if self.nodes else np.zeros(0)
        text = {k: np.array(v, dtype=str) for k, v in (("kind", [self.kind]), ("features", self.features), ("outputs", self.outputs), ("folds", self.folds))}
        text |= {f"category{self.features.index(f)}": np.array(v, dtype=str) for f, v in self.categories.items()}
        np.savez_compressed(out, start=self.start, gain=self.gain, **arrays, **text)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Boosted":
        held = np.load(io.BytesIO(data), allow_pickle=False)
        features = tuple(held["features"].tolist())
        nodes = list(zip(held["feature"], held["bin"], held["value"], strict=True)) if held["feature"].size else []
        return cls(
            str(held["kind"][0]),
            features,
            {features[int(k[8:])]: held[k].tolist() for k in held.files if k.startswith("category")},
            [held[f"edges{i}"] for i in range(len(features))],
            tuple(held["outputs"].tolist()),
            tuple(held["folds"].tolist()),
            held["start"],
            nodes,
            held["gain"],
        )


def _value(feature: str, categories: dict[str, list[str]]) -> Column:
    """A feature as a number; categories by their place, unknown ones behind all, NULL as 0."""
    if feature not in categories:
        return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    if not categories[feature]:
        return F.lit(0.0)
    known = F.array_position(F.array(*[F.lit(c) for c in categories[feature]]), F.col(feature).cast("string"))
    return F.when(known > 0, known - 1).otherwise(len(categories[feature])).cast("double")


def _route(nodes, x: np.ndarray, levels: int) -> list[np.ndarray]:
    """Node of every row (``x``: bins by feature) in each tree after ``levels`` decisions; rows stay in leaves."""
    n, flat = x.shape[1], x.reshape(-1)
    start, out = np.arange(n), []
    for feature, split in zip(nodes[0], nodes[1], strict=True):
        inner, own = feature >= 0, np.arange(len(feature))
        # a leaf leads to itself, whatever the bin
        first, last, left = np.maximum(feature, 0) * n, np.where(inner, split, np.iinfo(np.int64).max), np.where(inner, 2 * own + 1, own)
        at = np.zeros(n, dtype=np.int64)
        for _ in range(levels):
            cell = first.take(at)
            cell += start
            right = flat.take(cell) > last.take(at)
            at = left.take(at)
            at += right
        out.append(at)
    return out


def _add(kind: str, state: np.ndarray, rounds, x: np.ndarray, depth: int) -> np.ndarray:
    """Predictions (rows, folds, outputs) after some rounds more."""
    if len(rounds):
        state = np.array(state)
    for nodes in rounds:
        for t, at in enumerate(_route(nodes, x, depth)):
            if kind == SQUARED:
                state[:, t, :] += nodes[2][t].take(at, axis=0)
            else:
                state[:, 0, t] += nodes[2][t, :, 0].take(at)
    return state


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _blocks(b: pa.RecordBatch, shape: tuple[int, int, int]):
    """Bins by feature, targets, left-out folds and predictions of each block of rows."""
    folds, outputs, features = shape
    for x, y, hold, state in zip(*b.columns[:4], strict=True):
        hold = np.frombuffer(hold.as_buffer(), dtype=np.int32)
        n = len(hold)
        x = x.as_buffer()
        x = np.frombuffer(x, dtype=np.uint8 if x.size == n * features else np.uint16).reshape(features, n)
        yield x, np.frombuffer(y.as_buffer()).reshape(n, -1), hold, np.frombuffer(state.as_buffer()).reshape(n, folds, outputs)


def _add_sums(total: np.ndarray, kind: str, rows, nodes, level: int, bins: int) -> None:
    """Add the count, gradients (and, for softmax, curvature) of rows at a level to the sums of each tree."""
    x, y, hold, state = rows
    first, size, outputs = (1 << level) - 1, (1 << level) * bins, state.shape[2]
    if kind == SQUARED:
        grad = y[:, None, :] - state
    else:
        p = softmax(state[:, 0, :])
        grad = (np.arange(outputs)[None, :] == y[:, :1]) - p
    at = _route(nodes, x, level) if level else [np.zeros(len(y), dtype=np.int64)] * len(total)
    for t in range(len(total)):
        here = at[t] >= first
        if kind == SQUARED and t:
            here &= hold != t - 1
        use = slice(None) if here.all() else np.flatnonzero(here)
        local = (at[t][use] - first) * bins
        if kind == SQUARED:
            weights = [None, *np.ascontiguousarray(grad[use, t, :].T)]
        else:
            g = np.ascontiguousarray(grad[use, t])
            weights = [None, g, np.abs(g) * (1 - np.abs(g))]
        for f in range(len(x)):
            cell = local + x[f][use]
            for c, w in enumerate(weights):
                total[t, c, f] += np.bincount(cell, weights=w, minlength=size)


def _no_sums(kind: str, shape, level: int, bins: int) -> np.ndarray:
    folds, outputs, features = shape
    trees, channels = (folds, 1 + outputs) if kind == SQUARED else (outputs, 3)
    return np.zeros((trees, channels, features, (1 << level) * bins))


def _histograms(kind: str, shape, pending, nodes, level: int, depth: int, bins: int):
    """Sums of a level, one row a tree."""

    def add(batches):
        total = _no_sums(kind, shape, level, bins)
        for b in batches:
            for x, y, hold, state in _blocks(b, shape):
                _add_sums(total, kind, (x, y, hold, _add(kind, state, pending, x, depth)), nodes, level, bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([h.tobytes() for h in total], pa.binary())], names=["tree", "sums"])

    return add


def best_splits(sums: np.ndarray, min_rows: int) -> list[tuple[int, int, float]]:
    """Of a tree's summed histograms (count and gradients, feature, node, bin): per node the split
    feature (-1 if none saves anything), its last left bin, and what it saves.

    The loss that a split saves is the sum, over the gradients, of left squared / left count +
    right squared / right count - all squared / count.
    """
    left = np.cumsum(sums, axis=-1)
    everything = left[..., -1:]
    right = everything - left

    def worth(part):
        return (part[1:] ** 2).sum(axis=0) / np.maximum(part[0], 1)

    whole = worth(everything)
    gain = np.where((left[0] >= min_rows) & (right[0] >= min_rows), worth(left) + worth(right) - whole, -np.inf)
    found = []
    for node in range(sums.shape[2]):
        f, b = np.unravel_index(int(gain[:, node].argmax()), gain[:, node].shape)
        saved = float(gain[f, node, b])
        some = saved > 1e-12 * max(1.0, float(whole[f, node, 0]))
        found.append((int(f), int(b), saved) if some else (-1, 0, 0.0))
    return found


def _candidates(kind: str, tree: int, sums: np.ndarray, min_rows: int) -> list[tuple]:
    """The best split of every node of a tree and the sums on both sides, from summed histograms."""
    rows = []
    # the curvature is no gradient: it only scales leaves
    for node, (f, b, gain) in enumerate(best_splits(sums if kind == SQUARED else sums[:2], min_rows)):
        parts = np.cumsum(sums[:, max(f, 0), node, :], axis=-1)
        left, whole = parts[:, b], parts[:, -1]
        rows.append((tree, node, f, b, gain, left.tobytes(), (whole - left).tobytes(), whole.tobytes()))
    return rows


def _best(kind: str, features: int, width: int, bins: int, min_rows: int):
    def best(key, table):
        sums = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        rows = _candidates(kind, key[0].as_py(), sums.reshape(-1, features, width, bins), min_rows)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPLIT_TYPES, strict=True)], names=_SPLIT_NAMES)

    return best


_SPLIT_NAMES = ["tree", "node", "feature", "bin", "gain", "left", "right", "whole"]
_SPLIT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
_SPLITS = "tree int, node int, feature int, bin int, gain double, left binary, right binary, whole binary"


def _leaf(kind: str, sums: np.ndarray, step: float, classes: int) -> np.ndarray:
    if kind == SQUARED:
        return step * sums[1:] / max(sums[0], 1.0)
    return np.array([step * (classes - 1) / classes * sums[1] / sums[2] if sums[2] > 1e-12 else 0.0])


def _bin_rows(edges: list[np.ndarray], start: np.ndarray):
    """Blocks of rows from values, targets and left-out folds."""
    code = np.uint8 if max(len(e) for e in edges) < 256 else np.uint16

    def block(held):
        n = sum(len(h) for _, _, h in held)
        parts = [np.concatenate(c, axis=i) for c, i in zip(zip(*held, strict=True), (1, 0, 0), strict=True)]
        return _packed([*parts, np.broadcast_to(start, (n, *start.shape))])

    def rows(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(edges))
                coded = np.stack([np.searchsorted(e, x[:, i], side="left").astype(code) for i, e in enumerate(edges)])
                held.append((coded, b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), b.column(2).to_numpy()))
                n += b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return rows


_ROW_NAMES = ["x", "y", "hold", "state"]
_ROWS = "x binary, y binary, hold binary, state binary"


def _packed(parts) -> pa.RecordBatch:
    """A block as one row."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=_ROW_NAMES)


def _restate(kind: str, shape, pending, depth: int):
    def rows(batches):
        for b in batches:
            for x, y, hold, state in _blocks(b, shape):
                yield _packed([x, y, hold, _add(kind, state, pending, x, depth)])

    return rows


def fit(
    train: DataFrame, targets: Sequence[str], categories: Sequence[str] = (), numbers: Sequence[str] = (),
    kind: str = SQUARED, trees: Trees = Trees(), group: str | None = None, bins: int = BINS,
) -> Boosted:
    """Fit all ``targets`` (``squared``) or the classes of the one target (``softmax``).

    With ``group`` (``squared`` only) a fold is fitted for every value of that column, on the rows of
    all other values; fold 0, named "", always sees every row. Rows with a NULL target are left out.
    """
    if kind == SOFTMAX and (group or len(targets) != 1):
        raise ValueError("softmax takes one target and no folds")
    spark = train.sparkSession
    features = (*categories, *numbers)
    rows = train.dropna(subset=list(targets))
    known = {c: _labels(rows, c) for c in categories}
    outputs = tuple(targets) if kind == SQUARED else tuple(_labels(rows, targets[0]))
    folds = ("", *(_labels(rows, group) if group else ()))
    points = [i / bins for i in range(1, bins)]
    values = [_value(f, known) for f in features]
    n, *quantiles = rows.agg(F.count("*"), *[F.percentile_approx(v, points, 10000).alias(f"q{i}") for i, v in enumerate(values)]).first()
    edges = [_edges(known.get(f), q) for f, q in zip(features, quantiles, strict=True)]
    width = max(len(e) for e in edges) + 1

    if kind == SQUARED:
        y = F.array(*[F.col(t).cast("double") for t in targets])
    else:
        y = F.array((F.array_position(F.array(*[F.lit(c) for c in outputs]), F.col(targets[0]).cast("string")) - 1).cast("double"))
    hold = (F.array_position(F.array(*[F.lit(g) for g in folds[1:]]), F.col(group).cast("string")) - 1).cast("int") if group else F.lit(-1)
    start = _start(rows, targets, group, kind, outputs, folds)
    shape = (len(folds), len(outputs), len(features))
    coded = rows.select(F.array(*values).alias("x"), y.alias("y"), hold.alias("hold"))
    model = Boosted(kind, tuple(features), known, edges, outputs, folds, start, [], np.zeros(len(features)))

    def held(df: DataFrame) -> DataFrame:
        return workdir.materialise(df, "boosting")

    alone = n * len(folds) <= LOCAL_ROWS
    if not alone:
        # every job goes through all rows, so they are dealt evenly
        coded = coded.repartition(max(spark.sparkContext.defaultParallelism, n >> 20))
    table = bounded_batches(held(coded.mapInArrow(_bin_rows(edges, start), _ROWS)))
    if alone:
        grown = table.coalesce(1).mapInArrow(_fit_rows(kind, shape, trees, width), "nodes binary").first()
        _from_parts(model, bytes(grown["nodes"]))
        return model
    pending: list = []

    def ask(nodes, level: int) -> list:
        add = _histograms(kind, shape, pending, nodes, level, trees.depth, width)
        best = _best(kind, len(features), 1 << level, width, trees.min_rows)
        return table.mapInArrow(add, "tree int, sums binary").groupBy("tree").applyInArrow(best, _SPLITS).collect()

    for _ in range(trees.rounds):
        nodes = _round(kind, shape, trees, model.gain, ask)
        model.nodes.append(nodes)
        pending.append(nodes)
        if len(pending) == REWRITE:
            table = held(table.mapInArrow(_restate(kind, shape, pending, trees.depth), _ROWS))
            pending = []
    return model


def _round(kind: str, shape, trees: Trees, gain: np.ndarray, ask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of a round; ``ask`` gives the split candidates of a level."""
    folds, outputs, _ = shape
    n_trees, outs = (folds, outputs) if kind == SQUARED else (outputs, 1)
    size = (1 << (trees.depth + 1)) - 1
    nodes = (np.full((n_trees, size), -1, dtype=np.int64), np.zeros((n_trees, size), dtype=np.int64), np.zeros((n_trees, size, outs)))
    for level in range(trees.depth):
        grown = False
        for t, node, feature, last, saved, left, right, whole in ask(nodes, level):
            at = (1 << level) - 1 + node
            if level and nodes[0][t, (at - 1) // 2] < 0:
                continue
            if not level:
                nodes[2][t, at] = _leaf(kind, np.frombuffer(whole), trees.step, outputs)
            if feature < 0:
                continue
            grown = True
            nodes[0][t, at], nodes[1][t, at] = feature, last
            gain[feature] += saved if kind == SOFTMAX or t == 0 else 0.0
            for child, part in ((2 * at + 1, left), (2 * at + 2, right)):
                nodes[2][t, child] = _leaf(kind, np.frombuffer(part), trees.step, outputs)
        if not grown:
            break
    return nodes


def _fit_rows(kind: str, shape, trees: Trees, bins: int):
    """All rounds over a small table; one row with the nodes of all rounds and what each feature saved."""

    def fit_all(batches):
        held = [rows for b in batches for rows in _blocks(b, shape)]
        gain, rounds = np.zeros(shape[2]), []

        def ask(nodes, level: int) -> list:
            total = _no_sums(kind, shape, level, bins)
            for rows in held:
                _add_sums(total, kind, rows, nodes, level, bins)
            return [c for t, sums in enumerate(total) for c in _candidates(kind, t, sums.reshape(-1, shape[2], 1 << level, bins), trees.min_rows)]

        for _ in range(trees.rounds):
            rounds.append(_round(kind, shape, trees, gain, ask))
            held = [(x, y, hold, _add(kind, state, rounds[-1:], x, trees.depth)) for x, y, hold, state in held]
        out = io.BytesIO()
        np.savez_compressed(out, gain=gain, **{n: np.stack([r[i] for r in rounds]) for i, n in enumerate(("feature", "bin", "value")) if rounds})
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["nodes"])

    return fit_all


def _from_parts(model: Boosted, data: bytes) -> None:
    found = np.load(io.BytesIO(data), allow_pickle=False)
    model.gain = found["gain"]
    model.nodes = list(zip(found["feature"], found["bin"], found["value"], strict=True)) if "feature" in found.files else []


def _labels(rows: DataFrame, column: str) -> list[str]:
    """Distinct values as text, in order; models, folds and classes need each of them anyway."""
    from pyspark.ml.feature import StringIndexer

    indexed = StringIndexer(inputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip", outputCol="_code")
    return list(indexed.fit(rows.select(F.col(column).cast("string").alias("_label")).where("_label is not null")).labels)


def _edges(known: list[str] | None, quantiles) -> np.ndarray:
    """Last value of every bin but the last; categories have a bin each."""
    if known is not None:
        return np.arange(len(known), dtype=np.float64)
    return np.unique(np.array(quantiles or [], dtype=np.float64))


def _start(rows, targets, group, kind, outputs, folds) -> np.ndarray:
    """Mean of the targets, or log share of the classes, of the rows that each fold sees."""
    if kind == SOFTMAX:
        counts = {r["v"]: r["n"] for r in rows.groupBy(F.col(targets[0]).cast("string").alias("v")).agg(F.count("*").alias("n")).collect()}
        n = np.array([counts[c] for c in outputs], dtype=np.float64)
        return np.log(n / n.sum())[None, :]
    key = F.col(group).cast("string") if group else F.lit("")
    sums = [F.sum(F.col(t).cast("double")).alias(f"s{i}") for i, t in enumerate(targets)]
    found = {r[0]: np.array(r[1:], dtype=np.float64) for r in rows.groupBy(key.alias("v")).agg(F.count("*").alias("n"), *sums).collect()}
    total = sum(found.values())
    seen = [total, *[total - found[g] for g in folds[1:]]]
    return np.array([s[1:] / max(s[0], 1.0) for s in seen])


def predict(model: Boosted, df: DataFrame, name: str = "scores", fold: Column | None = None) -> DataFrame:
    """``df`` with ``name``: an array of the predicted targets, or of the class probabilities, in the
    order of ``model.outputs``. ``fold`` names the fold to use in each row; NULL and unknown ones, like
    no ``fold``, use the model of all rows."""
    depth = int(np.log2(model.nodes[0][0].shape[1] + 1)) - 1 if model.nodes else 0
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = sent.value
        for x, fold_at in batches:
            n = len(x)
            values = np.stack(x.to_numpy()) if n else np.zeros((0, len(m.features)))
            coded = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(m.edges)])
            state = _add(m.kind, np.broadcast_to(m.start, (n, *m.start.shape)), m.nodes, coded, depth)
            out = softmax(state[:, 0, :]) if m.kind == SOFTMAX else state[np.arange(n), fold_at.to_numpy(dtype=np.int64)]
            yield pd.Series(list(out))

    which = F.array_position(F.array(*[F.lit(f) for f in model.folds]), fold) - 1 if fold is not None else F.lit(0)
    inputs = F.array(*[_value(f, model.categories) for f in model.features])
    return df.withColumn(name, scores(inputs, F.greatest(F.coalesce(which, F.lit(0)), F.lit(0)).cast("int")))

