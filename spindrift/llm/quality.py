"""Supervised subword embeddings: averaged n-gram vectors, softmax, stochastic gradient descent.

A document is the average of the learned vectors of its hashed words, word pairs and character
n-grams; a softmax over two classes sits on top. Training runs in numpy in one task over a
bounded sample of labelled rows. As the average and the softmax's input are linear in the
vectors, scoring needs one number per bucket, so only that table is sent to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import mix64, offsets, ragged
from spindrift.llm.features import subwords, text_slices, tokens, word_hashes

BUCKETS = 1 << 17
DIM = 12
LOW, HIGH = 3, 5
EPOCHS = 6
RATE = 0.4
BATCH = 32
#: Labelled rows that training reads at most, chosen by a hash of their id.
MAX_TRAIN = 6000
_SAME = np.uint64(0x5851F42D4C957F2D)


def _pairs(code: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words (one hash for every repeated word) and how many each text has."""
    n = np.maximum(counts - 1, 0)
    at = ragged(offsets(counts)[:-1], n)
    a, b = hashes[code[at]], hashes[code[at + 1]]
    with np.errstate(over="ignore"):
        h = mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)
    h[a == b] = _SAME
    return h, n


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _feature_rows(batches):
    """Distinct buckets of each labelled text with their share of its features."""
    for b in batches:
        texts = b.column(2).to_pylist()
        for first, last in text_slices(texts):
            words, code, counts = tokens(texts[first:last], letters_only=False)
            h, n_sub = subwords(words, LOW, HIGH)
            sub, starts = _buckets(h), offsets(n_sub)[:-1]
            pair, n_pair = _pairs(code, counts, word_hashes(words))
            pair, ends, pair_ends = _buckets(pair), offsets(counts), offsets(n_pair)
            ids, shares = [], []
            for i in range(last - first):
                own = code[ends[i] : ends[i + 1]]
                every = np.concatenate([sub[ragged(starts[own], n_sub[own])], pair[pair_ends[i] : pair_ends[i + 1]]])
                at, n = np.unique(every, return_counts=True)
                ids.append(at.astype(np.int32))
                shares.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["id", "label", "buckets", "shares"])


def fit(buckets: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train; returns the score of each bucket and the bias, both as log-odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    output, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += len(rows)
            n = np.array([len(buckets[r]) for r in rows])
            flat, share = np.concatenate([buckets[r] for r in rows]), np.concatenate([shares[r] for r in rows])
            whose = np.repeat(np.arange(len(rows)), n)
            hidden = np.zeros((len(rows), DIM))
            full = np.flatnonzero(n)
            if len(full):
                hidden[full] = np.add.reduceat(vectors[flat] * share[:, None], offsets(n)[:-1][full], axis=0)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = p @ output.T
            output -= rate * hidden.T @ p
            bias -= rate * 0.1 * p.sum(axis=0)
            # as in the averaged model, each feature gets the document's whole gradient times its share;
            # the factor makes up for shares being small
            np.subtract.at(vectors, flat, (rate * SPREAD * share[:, None] * back[whose]).astype(np.float32))
    return vectors.astype(np.float64) @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


#: Steps on single vectors are this much longer than the average's gradient.
SPREAD = 100.0


def _score(sent, id_at: int, text_at: int, names: list[str]):
    def score(batches):
        table, bias = sent.value
        for b in batches:
            texts = b.column(text_at).to_pylist()
            for first, last in text_slices(texts):
                words, code, counts = tokens(texts[first:last], letters_only=False)
                h, n_sub = subwords(words, LOW, HIGH)
                # every word is summed by itself, so a score does not depend on the texts around it
                sub = np.bincount(np.repeat(np.arange(len(words)), n_sub), weights=table[_buckets(h)], minlength=len(words))
                pair, n_pair = _pairs(code, counts, word_hashes(words))
                whose = np.repeat(np.arange(last - first), counts)
                total = np.bincount(whose, weights=sub[code], minlength=last - first)
                total += np.bincount(np.repeat(np.arange(last - first), n_pair), weights=table[_buckets(pair)], minlength=last - first)
                n = np.bincount(whose, weights=n_sub[code], minlength=last - first) + n_pair
                logit = total / np.maximum(n, 1) + bias
                yield pa.RecordBatch.from_arrays([b.column(id_at).slice(first, last - first), pa.array(1 / (1 + np.exp(-logit)))], names=names)

    return score


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_train`` labelled rows for which ``usable`` holds, chosen by a hash of
    their id. Labels other than 0 and 1 and rows without id are left out; of repeated labels the
    largest counts. Without any usable row every score is one half."""
    marked = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_label", "_text")
    found = rows.mapInArrow(_feature_rows, T.StructType([T.StructField("id", texts.schema["_doc"].dataType), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))]))
    # a bounded sample: one task fits, and the driver gets one number per bucket
    fitted = found.repartition(1).mapInArrow(_fit_rows, "scores binary, bias double").collect()
    return (np.frombuffer(fitted[0]["scores"]), fitted[0]["bias"]) if fitted else (np.zeros(BUCKETS), 0.0)


def _fit_rows(batches):
    rows = []
    for b in batches:
        ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows += [(i, y, b.column(2)[n].values.to_numpy(), b.column(3)[n].values.to_numpy()) for n, (i, y) in enumerate(zip(ids, labels, strict=True))]
    if rows:
        rows.sort(key=lambda r: (r[0], len(r[2])))
        scores, bias = fit([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([scores.tobytes()], pa.binary()), pa.array([bias])], names=["scores", "bias"])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>`` and ``score``, the probability of label 1, for every row and whole text.

    Null, empty and white-space texts have no features and get the score of the bias alone. Rows
    don't meet, so ids may repeat or be null. An empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([chosen.schema[0], T.StructField("score", T.DoubleType())])
    return chosen.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), 0, 1, schema.names), schema)
