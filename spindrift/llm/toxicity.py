"""Toxicity by a chain of linear classifiers, each fed the probabilities of those before it.

Categories are predicted in a fixed order. A category's model sees hashed words and character
n-grams and the log-odds that the earlier categories got; in training these come from models
that did not see the row (out of fold), so that a later model learns how far to trust them.
Every model is a logistic regression with L1, fitted by follow-the-regularised-leader in numpy;
L1 leaves few weights, so long clean texts gather no noise. All labelled rows are learned: they are
dealt to blocks of bounded size, a group fits the chain of a block, and the weights of the blocks
are averaged (linear models, so this is the mean of their log-odds).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spindrift.llm.common import bounded_batches, discard, offsets, ragged, returning_memory, write
from spindrift.llm.features import subwords, text_slices, tokens

BUCKETS = 1 << 20
LOW, HIGH = 4, 6
FOLDS = 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.1
#: Labelled rows in a block; further rows make further blocks.
BLOCK_ROWS = 4000
#: Rows of each class that a block holds, if there are so many: fewer rows of a class serve several blocks.
LEAST = 250
#: Share of the clean rows that the threshold may reject, judged on out-of-fold scores.
FALSE_ALARMS = 0.001
#: Weak labels: a toxic row belongs to a category if it holds one of these words (our own short lists).
SEEDS: Mapping[str, Sequence[str]] = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown"),
    "contempt": ("scum", "trash", "worthless", "disgusting", "pathetic"),
}
TARGET = "toxic"


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _feature_rows(seeds: Mapping[str, Sequence[str]]):
    def rows(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for first, last in text_slices(texts):
                words, code, counts = tokens(texts[first:last], letters_only=True)
                h, n = subwords(words, LOW, HIGH)
                at, starts, ends = _buckets(h), offsets(n)[:-1], offsets(counts)
                seeded = np.array([[w in seeds[c] for c in seeds] for w in words], dtype=bool).reshape(len(words), len(seeds))
                ids, weak = [], []
                for i in range(last - first):
                    own = np.unique(code[ends[i] : ends[i + 1]])
                    ids.append(np.unique(at[ragged(starts[own], n[own])]).astype(np.int32))
                    weak.append(seeded[own].any(axis=0).tolist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array(ids, pa.list_(pa.int32())), pa.array(weak, pa.list_(pa.bool_()))], names=["id", "label", "buckets", "weak"])

    return returning_memory(rows)


class Linear:
    """Logistic regression over present buckets, some dense inputs and a bias."""

    def __init__(self, dense: int, buckets: int = BUCKETS):
        self.weights = np.zeros(buckets + dense + 1)
        self.dense, self.buckets = dense, buckets

    def log_odds(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        sums = np.array([self.weights[r].sum() for r in rows])
        return sums + dense @ self.weights[self.buckets : self.buckets + self.dense] + self.weights[-1]


def _rows_of(rows: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold each bucket one after another, and where those of each bucket begin."""
    flat = np.concatenate(rows)
    order = np.argsort(flat, kind="stable")
    return np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[order], offsets(np.bincount(flat, minlength=buckets))


def _fit_side_by_side(rows: list[np.ndarray], holders: tuple[np.ndarray, np.ndarray], dense: np.ndarray, labels: np.ndarray, chosen: Sequence[np.ndarray], buckets: int, seed: int) -> np.ndarray:
    """Weights of models that are fitted together, each on its ``chosen`` rows in an order of its own; a step is a row of each.

    A bucket has no weight until the sum of its errors has been above L1, and few ever get there. The sum of their squares
    is needed from then on, so it is not kept for the others but taken from the rows that hold the bucket.
    """
    models = len(chosen)
    z, n, active = np.zeros(models * buckets), np.zeros(models * buckets), np.zeros(models * buckets, dtype=bool)
    squares = np.zeros((models, len(rows)))
    # the dense inputs and the bias are not thinned out
    x = np.column_stack([dense, np.ones(len(rows))])
    z_tail, n_tail = np.zeros((models, x.shape[1])), np.zeros((models, x.shape[1]))
    orders = []
    for own in chosen:
        rng = np.random.default_rng(seed)
        orders.append(np.concatenate([own[rng.permutation(len(own))] for _ in range(EPOCHS)]))

    def weights(z, n, l1):
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def slower(n, g):
        return (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA

    for step in range(max(map(len, orders))):
        live = np.array([m for m, order in enumerate(orders) if step < len(order)])
        now = np.array([orders[m][step] for m in live])
        at = np.concatenate([rows[r] + m * buckets for m, r in zip(live.tolist(), now.tolist(), strict=True)])
        zr = z.take(at)
        on = np.flatnonzero(active.take(at))
        held = at[on]
        model = np.searchsorted(live, held // buckets)
        z_on, n_on, zt, nt = zr[on], n[held], z_tail[live], n_tail[live]
        w, w_tail = weights(z_on, n_on, L1), weights(zt, nt, 0.0)
        odds = np.bincount(model, weights=w, minlength=len(live)) + (w_tail * x[now]).sum(axis=1)
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[now]
        zr += np.repeat(error, [len(rows[r]) for r in now])
        e = error[model]
        zr[on] = z_on + e - slower(n_on, e) * w
        z[at], n[held] = zr, n_on + e * e
        squares[live, now] += error * error
        g = error[:, None] * x[now]
        z_tail[live], n_tail[live] = zt + g - slower(nt, g) * w_tail, nt + g * g
        zr[on] = 0.0
        if len(at) and np.abs(zr, out=zr).max() > L1:
            for b in at[zr > L1].tolist():
                m, bucket = divmod(b, buckets)
                active[b] = True
                n[b] = squares[m, holders[0][holders[1][bucket] : holders[1][bucket + 1]]].sum()
    return np.hstack([weights(z, n, L1).reshape(models, buckets), weights(z_tail, n_tail, 0.0)])


class Chain(list):
    """The models in their order, and the probability of the last above which a row is rejected."""

    threshold = 0.5


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, seed: int = 11) -> list[Linear]:
    """One model per column of ``labels``; later ones are trained on out-of-fold log-odds of the earlier."""
    return _fit_chain(rows, labels, folds, seed)[0]


def _fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, seed: int = 11, buckets: int = BUCKETS) -> tuple[list[Linear], list[list[Linear]]]:
    """The models, and for each fold the chain that did not see it."""
    dense, chain, outer = np.zeros((len(rows), 0)), [], [[] for _ in range(FOLDS)]
    # frequent buckets lie together, where a core's cache holds them
    rank = np.empty(buckets, dtype=np.int64)
    rank[np.argsort(-np.bincount(np.concatenate(rows), minlength=buckets), kind="stable")] = np.arange(buckets)
    near = [np.sort(rank[r]) for r in rows]
    holders = _rows_of(near, buckets)
    for c in range(labels.shape[1]):
        outside = np.zeros(len(rows))
        # the last one sees all rows
        seen = [np.flatnonzero(folds != f) for f in range(FOLDS + 1)]
        models = [Linear(c, buckets) for _ in range(FOLDS + 1)]
        for model, weights in zip(models, _fit_side_by_side(near, holders, dense, labels[:, c], seen, buckets, seed), strict=True):
            model.weights = np.append(weights[rank], weights[buckets:])
        for f in range(FOLDS):
            unseen = np.flatnonzero(folds == f)
            outside[unseen] = models[f].log_odds([rows[i] for i in unseen], dense[unseen])
            outer[f].append(models[f])
        chain.append(models[-1])
        dense = np.column_stack([dense, _squash(outside)])
    return chain, outer


def cut(log_odds: np.ndarray, toxic: np.ndarray, false_alarms: float = FALSE_ALARMS) -> float:
    """Log-odds above which a row is rejected: the most toxic rows while at most ``false_alarms`` of
    the clean ones are; halfway to the next toxic row. Without rows of both kinds nothing is rejected."""
    clean, found = np.sort(log_odds[~toxic])[::-1], np.sort(log_odds[toxic])
    if not len(clean) or not len(found):
        return np.inf
    low = clean[int(false_alarms * len(clean))]
    above = found[found > low]
    return float((low + above[0]) / 2) if len(above) else float(low)


def _squash(log_odds: np.ndarray) -> np.ndarray:
    """Bounded log-odds, so that one certain category can't drown the words."""
    return np.tanh(log_odds / 4) * 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = TARGET, seeds: Mapping[str, Sequence[str]] = SEEDS, block_rows: int = BLOCK_ROWS) -> Chain:
    """Fit the chain (the seeded categories in their order, then ``label_col``) on all labelled rows.

    Rows are dealt by a hash of their id to blocks of about ``block_rows`` rows; a class of fewer than
    ``LEAST`` rows a block has its rows in several blocks. Every block fits the chain,
    the weights are averaged, and the biases are moved to the classes' true shares. The threshold is ``cut`` of the
    out-of-fold scores of all rows, by the averages of the models that did not see their fold: without
    labelled rows of both classes nothing is rejected. Labels other than 0 and 1 and rows without id are
    left out; of repeated labels the largest counts. Without any labelled row every probability is
    one half and nothing is rejected."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    shares = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, -(-sum(shares.values()) // block_rows))
    own = [max(1, min(blocks, shares.get(v, 0) // LEAST)) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(marked, F.col("_doc") == F.col("_id"))
    # the rows of one block are numbered, those of several are drawn
    number = F.row_number().over(Window.orderBy("_id", F.length("_text"))) - 1 if blocks == 1 else F.xxhash64("_id")
    path = write(bounded_batches(rows).select("_id", "_label", F.pmod(number, F.lit(FOLDS)).cast("int").alias("_fold"), "_text"), "toxicity-rows")
    rows = spark.read.parquet(path)
    n_own = F.when(F.col("_label") == 0, own[0]).otherwise(own[1])
    group = F.pmod(F.xxhash64("_id", F.lit(FOLDS)), n_own).cast("int")
    # few blocks share one of so many partitions
    dealt = rows.withColumn("_block", F.explode(F.sequence(group, F.lit(blocks - 1), n_own))).repartition(1 if blocks == 1 else 8 * blocks, "_block")
    parts = dealt.groupBy("_block").applyInArrow(_fit_block(seeds, shares.get(0, 0), shares.get(1, 0)), "block int, model int, fold int, at int, weight double")
    # summed in the order of the blocks, so that a repeated run gives the same weights
    held = F.array_sort(F.collect_list(F.struct("block", "weight")))
    total = F.aggregate(held, F.lit(0.0), lambda a, p: a + p["weight"])
    fitted = parts.groupBy("model", "fold", "at").agg(total.alias("total"), F.count("*").alias("n")).toArrow()
    chain = Chain(Linear(c) for c in range(len(seeds) + 1))
    model, fold, at, weight, n = (fitted.column(c).to_numpy() for c in ("model", "fold", "at", "total", "n"))
    if not len(model):
        discard(spark, path)
        return chain
    shift = (weight / n)[model < 0][0]
    weight = weight / n[model < 0][0]
    outer = [[Linear(c) for c in range(len(chain))] for _ in range(FOLDS)]
    for f, models in [(-1, chain), *enumerate(outer)]:
        for c, m in enumerate(models):
            mine = (fold == f) & (model == c)
            m.weights[at[mine]] = weight[mine]
    odds = rows.select("_fold", "_label", "_text").mapInArrow(_outside(_sent(spark, [m for models in outer for m in models])), "label int, odds double")
    chain.threshold = float(1 / (1 + np.exp(-np.float64(_cut_rows(odds) + shift))))
    for m in chain:
        m.weights[-1] += shift
    discard(spark, path)
    return chain


def _cut_rows(odds: DataFrame, false_alarms: float = FALSE_ALARMS) -> float:
    """``cut`` of a frame of labels and log-odds; it is written once."""
    path = write(odds, "toxicity-odds")
    odds = odds.sparkSession.read.parquet(path)
    clean, toxic = odds.where("label = 0"), odds.where("label = 1")
    n = {r["label"]: r["n"] for r in odds.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if n.get(0) and n.get(1):
        low = clean.orderBy(F.desc("odds")).limit(int(false_alarms * n[0]) + 1).agg(F.min("odds")).first()[0]
        above = toxic.where(F.col("odds") > low).agg(F.min("odds")).first()[0]
    discard(odds.sparkSession, path)
    if not n.get(0) or not n.get(1):
        return np.inf
    return low if above is None else (low + above) / 2


_PARTS = pa.schema([("block", pa.int32()), ("model", pa.int32()), ("fold", pa.int32()), ("at", pa.int32()), ("weight", pa.float64())])


def _fit_block(seeds: Mapping[str, Sequence[str]], n_clean: int, n_toxic: int):
    """The weights of a block's chain (fold -1) and of the chains that did not see a fold, without zeros; model -1 is the shift of the biases."""

    def fit(key, table):
        def run(batches):
            rows = []
            folds = [f for b in batches for f in b.column("_fold").to_pylist()]
            texts = (b.select(["_id", "_label", "_text"]) for b in batches)
            for b in _feature_rows(seeds)(texts):
                ids, labels, weak = (b.column(i).to_pylist() for i in (0, 1, 3))
                rows += [(i, y, w, b.column(2)[n].values.to_numpy()) for n, (i, y, w) in enumerate(zip(ids, labels, weak, strict=True))]
            order = sorted(range(len(rows)), key=lambda i: (rows[i][0], len(rows[i][3])))
            rows, folds = [rows[i] for i in order], np.array(folds)[order]
            toxic = np.array([r[1] for r in rows])
            weak = np.array([r[2] for r in rows], dtype=bool).reshape(len(rows), -1)
            targets = np.column_stack([weak & (toxic == 1)[:, None], toxic]).astype(np.float64)
            # a bucket of a single row says nothing about others
            common = np.bincount(np.concatenate([r[3] for r in rows]), minlength=BUCKETS) > 1
            # the models have a place for each common bucket, in the order of the buckets
            used, place = np.flatnonzero(common), np.cumsum(common, dtype=np.int32) - 1
            held = [place[r[3][common[r[3]]]] for r in rows]
            del rows
            chain, outer = _fit_chain(held, targets, folds, buckets=len(used))
            drawn, clean = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
            shift = np.log(max(1, n_toxic) / max(1, n_clean)) - np.log(drawn / clean)
            found = [(-1, -1, np.zeros(1, dtype=np.int64), np.array([shift]))]
            for f, models in [(-1, chain), *enumerate(outer)]:
                for c, model in enumerate(models):
                    at = np.flatnonzero(model.weights)
                    found.append((c, f, np.append(used, np.arange(BUCKETS, BUCKETS + c + 1))[at], model.weights[at]))
            for c, f, at, weights in found:
                columns = [np.full(len(at), key[0].as_py()), np.full(len(at), c), np.full(len(at), f), at, weights]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _PARTS.types, strict=True)], schema=_PARTS)

        return pa.Table.from_batches(list(returning_memory(run)(table.to_batches())), schema=_PARTS)

    return fit


def _sent(spark: SparkSession, models: Sequence[Linear]):
    """Buckets with a weight in any model, their weights, and the dense weights and biases of the models."""
    weights = np.column_stack([m.weights[:BUCKETS] for m in models])
    used = np.flatnonzero((weights != 0).any(axis=1))
    return spark.sparkContext.broadcast((used, weights[used], [m.weights[BUCKETS : BUCKETS + m.dense] for m in models], [m.weights[-1] for m in models]))


def _places(used: np.ndarray) -> np.ndarray:
    row = np.full(BUCKETS, -1, dtype=np.int64)
    row[used] = np.arange(len(used))
    return row


def _hits(texts: list[str | None], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place in ``row`` of each weighted bucket that a text holds; a bucket counts once a text."""
    words, code, counts = tokens(texts, letters_only=True)
    h, n = subwords(words, LOW, HIGH)
    at = row[_buckets(h)]
    keep = at >= 0
    whose = np.repeat(np.arange(len(words)), n)[keep]
    n, at = np.bincount(whose, minlength=len(words)), at[keep]
    doc = np.repeat(np.repeat(np.arange(len(texts)), counts), n[code])
    hit = np.unique(doc * BUCKETS + at[ragged(offsets(n)[:-1][code], n[code])])
    return hit // BUCKETS, hit % BUCKETS


def _outside(sent):
    """The last log-odds of each row by the chain that did not see its fold."""

    def score(batches):
        used, weights, dense, bias = sent.value
        row, last_model = _places(used), weights.shape[1] // FOLDS
        for b in batches:
            folds, texts = b.column(0).to_numpy(), b.column(2).to_pylist()
            for first, last in text_slices(texts):
                doc, at = _hits(texts[first:last], row)
                own = folds[first:last].astype(np.int64) * last_model
                earlier = np.zeros((last - first, 0))
                for c in range(last_model):
                    odds = np.bincount(doc, weights=weights[at, own[doc] + c], minlength=last - first) + np.array([earlier[i] @ dense[m + c] + bias[m + c] for i, m in enumerate(own)])
                    earlier = np.column_stack([earlier, _squash(odds)])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, last - first), pa.array(odds, pa.float64())], names=["label", "odds"])

    return returning_memory(score)


def _score(sent, field: int | None, names: list[str]):
    """``field``: place of the text in the struct that is the second column, or None for a column of texts."""

    def score(batches):
        used, weights, dense, bias = sent.value
        row = _places(used)
        for b in batches:
            held = b.column(1) if field is None else b.column(1).field(field)
            texts = [t if t is None or isinstance(t, str) else str(t) for t in held.to_pylist()]
            for first, last in text_slices(texts):
                doc, at = _hits(texts[first:last], row)
                earlier = np.zeros((last - first, 0))
                for c in range(weights.shape[1]):
                    odds = np.bincount(doc, weights=weights[at, c], minlength=last - first) + earlier @ dense[c] + bias[c]
                    earlier = np.column_stack([earlier, _squash(odds)])
                    final = odds if c == 0 else np.column_stack([final, odds])
                final = final.reshape(last - first, -1)
                p = 1 / (1 + np.exp(-np.clip(final, -500, 500)))
                kept = [c.slice(first, last - first) for c in b.columns[: 1 if field is None else 2]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=names)

    return returning_memory(score)


def score_toxicity(
    docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", seeds: Mapping[str, Sequence[str]] = SEEDS,
    threshold: float | None = None, carry: bool = True,
) -> DataFrame:
    """``<id_col>``, ``row`` (a struct of all input columns, left out unless ``carry``), ``p_<category>``
    for every category of the chain, ``p_toxic`` and ``rejected`` (``p_toxic`` above ``threshold``, by
    default the chain's own) for every row and whole text.

    Null, empty and white-space texts have no features and get the probabilities of the biases.
    Rows don't meet, so ids may repeat or be null. An empty table gives an empty result. A text
    goes to Python once, inside its row or alone.
    """
    sent = _sent(docs.sparkSession, chain)
    text = F.struct("*").alias("row") if carry else F.col(text_col).cast("string").alias("_text")
    chosen = bounded_batches(docs).select(F.col(id_col), text)
    schema = T.StructType([*chosen.schema[: 2 if carry else 1], *[T.StructField(f"p_{c}", T.DoubleType()) for c in (*seeds, TARGET)]])
    scored = chosen.mapInArrow(_score(sent, docs.columns.index(text_col) if carry else None, schema.names), schema)
    return scored.withColumn("rejected", F.col(f"p_{TARGET}") > (chain.threshold if threshold is None else threshold))
