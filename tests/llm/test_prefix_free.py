"""Removal of repeated byte strings against a table of all strings."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import prefix_free as pf

SIZE = 50


def brute(rows, size=SIZE):
    coded = [(pf.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in sorted(coded):
        for p in range(len(t) - size + 1):
            first.setdefault(t[p : p + size], i)
    out = []
    for (i, _), (k, t) in zip(rows, coded, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < k:
                gone[p : p + size] = b"\1" * size
        spans = []
        for j, x in enumerate(gone):
            if x and (not j or not gone[j - 1]):
                spans.append([j, j])
            if x:
                spans[-1][1] = j + 1
        out.append((i, len(t), sum(gone), len(spans), tuple(map(tuple, spans)), bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return sorted(out, key=str)


def flat(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


def drawn(seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh é", "aé漢", "a"][seed % 4]
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(8)] + ["a" * 300, "xyz" * 60, "x" * 49, "q" * 50]
    rows = []
    for i in range(rng.randint(1, 60)):
        parts = [rng.choice(pool)[rng.randint(0, 20) : rng.randint(30, 250)] if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, 5, None]) if rng.random() < 0.3 else i, "".join(parts) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rows = drawn(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, n_spans string")
    want = brute(rows)
    # one part; many parts; many parts with every trigger of over two phrases dealt string by string
    assert flat(pf.remove_repeated(docs)) == want
    assert flat(pf.remove_repeated(docs, part_bytes=1500)) == want
    assert flat(pf.remove_repeated(docs, part_bytes=1500, hot=2)) == want


def test_many_buckets_of_triggers(spark, monkeypatch):
    monkeypatch.setattr(pf, "BUCKET_KEYS", 20)
    rows = drawn(9)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert flat(pf.remove_repeated(docs, part_bytes=800)) == brute(rows)


def test_a_passage_in_all_documents_with_changing_ends(spark):
    rng = random.Random(3)
    passage = "the same forty bytes stand in each of them"
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(40)) + passage + "".join(rng.choice("abcdef ") for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + "tail") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    for hot in (5, 1 << 15):
        assert flat(pf.remove_repeated(docs, part_bytes=4000, hot=hot)) == want


def test_very_long_and_empty(spark):
    rng = random.Random(4)
    long_ = "".join(rng.choice("abcdefghij ") for _ in range(1500000))
    rows = [(2, long_), (1, long_[700000:700060]), (3, None), (4, "")]
    got = {r[0]: r[1:4] for r in flat(pf.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {2: (1500000, 60, 1), 1: (60, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert pf.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        pf.remove_repeated(spark.createDataFrame(rows, "n_bytes long, text string"), id_col="n_bytes")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.builds(lambda a, k, b: a * k + b, st.binary(min_size=1, max_size=30), st.integers(1, 12), st.binary(max_size=40)), min_size=1, max_size=5), st.sampled_from([32, 40, 50]))
def test_corpus_order_tells_equal_strings(texts, size):
    texts = [t for t in texts if len(t) >= size] or [bytes(size)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    low, high, trigger, _ = pf.parse(data, np.cumsum([0, *map(len, texts)]), size, np.zeros(0, dtype=np.uint64))
    assert (high - low).sum() == sum(len(t) - size + 1 for t in texts)
    order_of = np.argsort(trigger, kind="stable")
    for t in np.unique(trigger):
        mine = order_of[trigger[order_of] == t]
        parts = [data[low[i] : high[i] + size - 1] for i in mine]
        strings = [p[j : j + size].tobytes() for p in parts for j in range(len(p) - size + 1)]
        order, same = pf.corpus_order(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), trigger[mine], size)
        ordered = [strings[i] for i in order]
        assert [a == b for a, b in zip(ordered, ordered[1:], strict=False)] == same[1:].tolist()
        assert ordered == sorted(strings)


def test_the_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame(drawn(1), "doc_id long, text string")
    df = pf.remove_repeated(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 2
