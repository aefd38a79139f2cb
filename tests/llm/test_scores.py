"""Scores of the two classifiers against loops that add up weights word by word, and the pipeline on odd tables."""

import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import quality, toxicity

MASK, GOLD = (1 << 64) - 1, 0x9E3779B97F4A7C15
TEXTS = ["you are a Clown and a clown", "", None, "x", "naïve 漢字 🙂🙂 -- ok", "word word word other", " \n\t", "tail. of, things; " * 300]


def mix(x):
    x = (x + GOLD) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def grams(word, low, high):
    marked, out = f"<{word}>", [xxhash.xxh3_64_intdigest(word)]
    for n in range(low, high + 1):
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = (h * GOLD + ord(c) + 1) & MASK
            out.append(mix(h))
    return out


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)


def test_toxicity_scores_add_up_weights(spark):
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(toxicity.Linear(c) for c in range(3))
    for m in chain:
        m.weights[:] = rng.normal(0, 0.3, len(m.weights)) * (rng.random(len(m.weights)) < 0.5)
    for r in toxicity.score_toxicity(frame(spark), chain, carry=False).collect():
        words = re.sub(r"[\W_]+", " ", (TEXTS[r.doc_id] or "").lower()).split()
        held = {h % toxicity.BUCKETS for w in words for h in grams(w, toxicity.LOW, toxicity.HIGH)}
        earlier, want = [], []
        for m in chain:
            odds = sum(m.weights[b] for b in held) + sum(w * e for w, e in zip(m.weights[toxicity.BUCKETS :], earlier, strict=False)) + m.weights[-1]
            earlier.append(math.tanh(odds / 4) * 4)
            want.append(sigmoid(odds))
        assert [r.p_insult, r.p_contempt, r.p_toxic] == pytest.approx(want, abs=1e-9)


def test_quality_scores_add_up_weights_and_do_not_depend_on_neighbours(spark):
    table, bias = np.random.default_rng(3).normal(0, 1, quality.BUCKETS), 0.25
    docs = frame(spark)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, (table, bias)).collect()}
    for i, text in enumerate(TEXTS):
        words = (text or "").split()
        held = [h for w in words for h in grams(w, quality.LOW, quality.HIGH)]
        for a, b in zip(words, words[1:], strict=False):
            x, y = xxhash.xxh3_64_intdigest(a), xxhash.xxh3_64_intdigest(b)
            held.append(int(quality._SAME) if a == b else mix((x * GOLD + y) & MASK))
        total = sum(table[h % quality.BUCKETS] for h in held)
        assert got[i] == pytest.approx(sigmoid(total / max(1, len(held)) + bias), abs=1e-9)
        alone = quality.score_quality(docs.where(F.col("doc_id") == i), (table, bias)).first().score
        assert alone == got[i]


def test_models_hold_the_buckets_that_rows_share(monkeypatch):
    """Fitting takes places for common buckets only, and gives the weights that all places would have."""
    rng = np.random.default_rng(5)
    held = [np.unique(rng.integers(0, 400, 30) * 2003) for _ in range(60)]
    labels = np.array([float(len(h) % 2) for h in held])
    whole, _ = toxicity._fit_chain(held, np.column_stack([labels, labels]), np.arange(60) % toxicity.FOLDS)
    used = np.unique(np.concatenate(held))
    small, _ = toxicity._fit_chain([np.searchsorted(used, h) for h in held], np.column_stack([labels, labels]), np.arange(60) % toxicity.FOLDS, buckets=len(used))
    for c, (a, b) in enumerate(zip(whole, small, strict=True)):
        assert len(b.weights) == len(used) + c + 1 and np.array_equal(a.weights[used], b.weights[: len(used)]) and np.array_equal(a.weights[-c - 1 :], b.weights[-c - 1 :])


def test_toxicity_learns_every_labelled_row(spark):
    """Ids of all rows that a fit reads are those of all labelled rows, whatever the size of a block; the threshold is ``cut`` of all their scores."""
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" scum idiot" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    read, plain = spark.sparkContext.accumulator(0), toxicity._fit_block
    scored = []

    def counted(*args):
        fit = plain(*args)

        def run(key, table):
            read.add(table.num_rows)
            return fit(key, table)

        return run

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_fit_block", counted)
        patch.setattr(toxicity, "LEAST", 10)
        cut_rows = toxicity._cut_rows
        patch.setattr(toxicity, "_cut_rows", lambda odds: scored.append([tuple(r) for r in odds.collect()]) or cut_rows(odds))
        chain = toxicity.train(docs, labels, block_rows=100)
    assert read.value == 400 and len(scored[0]) == 400
    odds, toxic = np.array([o for _, o in scored[0]]), np.array([y == 1 for y, _ in scored[0]])
    assert -math.log(1 / chain.threshold - 1) == pytest.approx(toxicity.cut(odds, toxic), abs=0.2)
    got = {r.doc_id: r.rejected for r in toxicity.score_toxicity(docs, chain, carry=False).collect()}
    assert all(got[i] == (y == 1) for i, _, y in rows)


def test_threshold_keeps_false_alarms_within_their_share():
    odds, toxic = np.array([-3.0, -2, -1, 0.5, 2, 3, -2.5]), np.array([False, False, False, False, True, True, True])
    assert toxicity.cut(odds, toxic, 0.0) == 1.25 and toxicity.cut(odds, toxic, 0.25) == 0.5
    assert toxicity.cut(odds, np.zeros(7, dtype=bool)) == math.inf == toxicity.cut(odds[4:5], toxic[4:5])


def test_the_pipeline_takes_odd_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, spans int, key int"
    rows = [(1, "same text of these rows here", "en", "s", 28, "r", 1, 2)] * 3 + [(1, "another text", "en", "s", 12, "r", 1, 2), (None, "no id at all", None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    for name, data in (("odd", rows), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, columns).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)][: len(data)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, folder), stage_name)
            assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in packed} == ({1, 2, None} if data else set())
