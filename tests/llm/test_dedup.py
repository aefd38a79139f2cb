"""Exact, line, near-copy and embedding dedup against plain Python on small frames."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import embedding_dedup as emb
from spindrift.llm import minhash
from spindrift.llm.components import components
from spindrift.llm.cuckoo import CuckooFilter
from spindrift.llm.exact_dedup import exact_dedup
from spindrift.llm.line_dedup import LineStore, drop_common_lines, line_key

DOCS = "doc_id long, text string"


def labels_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


# ---- exact


def exact_expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_equals_plain_grouping(spark, rows):
    data = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "lone"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "b"), (9, "b"), (10, "A")]
    frame = spark.createDataFrame([(i, t, "n", i) for i, t in data], "doc_id long, text string, h string, maybe long")
    assert rows(exact_dedup(frame)) == exact_expected(data)


def test_exact_dedup_in_several_turns_and_on_an_empty_table(spark, rows, monkeypatch):
    import spindrift.llm.exact_dedup as module

    data = [(i, f"text {i % 700}") for i in range(1000)]
    frame = spark.createDataFrame(data, DOCS).repartition(5)
    assert rows(exact_dedup(frame, bits_per_row=50_000, turn_bytes=2 << 20)) == exact_expected(data)
    assert rows(exact_dedup(frame.limit(0))) == []
    assert module.SHARD_BITS == 1 << 23


def test_a_hot_text_is_one_group(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup(frame.repartition(8)).where("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.sum(F.col("kept").cast("int")), F.max("group_size")).first()
    assert tuple(got) == (1000, 2997, 1, 1000)


# ---- lines


def test_cuckoo_filter_inserts_deletes_and_survives_bytes():
    keys = [line_key(str(i).encode()) for i in range(5000)]
    cuckoo = CuckooFilter(4000)
    cuckoo.insert(keys[:3000])
    again = CuckooFilter.from_bytes(cuckoo.to_bytes())
    assert again.contains(keys[:3000]).all()
    assert again.contains(keys[3000:]).mean() < 0.01
    again.delete(keys[:1500])
    assert again.contains(keys[1500:3000]).all() and again.contains(keys[:1500]).mean() < 0.01


def test_an_overfull_cuckoo_filter_keeps_its_promise():
    keys = [line_key(str(i).encode()) for i in range(200)]
    cuckoo = CuckooFilter(8)
    cuckoo.insert(keys)
    assert cuckoo.stash and CuckooFilter.from_bytes(cuckoo.to_bytes()).contains(keys).all()
    cuckoo.delete(keys)
    assert not cuckoo.stash and not cuckoo.table.any()


def lines_expected(data, least):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    found = collections.Counter(k for _, t in data for k in {key(x) for x in (t or "").split("\n")} if k)
    gone = {k for k, n in found.items() if n >= least}
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


LINES = [
    *[(i, f"Shared Line\nown {i}\n\nÉcole") for i in range(6)],
    (6, "  shared line\t\nrest"),
    (7, "\x0bSHARED LINE"),
    (8, None),
    (9, ""),
    (None, "shared line\r\nno id"),
    (10, "école\nshared line x"),
    (11, "shared line\n" * 50 + "tail"),
    (11, "shared line\n" * 50 + "tail"),
    (12, "long " * 50_000 + "\nshared line"),
]


def test_common_lines_go(spark, rows):
    frame = spark.createDataFrame([(i, t, t, 1) for i, t in LINES], "doc_id long, text string, row string, key int")
    for least in (3, 7, 100):
        got = drop_common_lines(frame, LineStore.build(frame, min_docs=least)).select("row.doc_id", "n_lines", "n_dropped", "kept_text")
        assert rows(got) == lines_expected(LINES, least)


def test_inserted_and_deleted_documents_leave_the_store_as_it_was(spark, rows):
    frame = spark.createDataFrame(LINES, DOCS)
    more = spark.createDataFrame([(100 + i, "École\nnew line") for i in range(4)], DOCS)
    store = LineStore.build(frame, min_docs=7)
    grown = store.insert(more)
    both = LINES + [(r.doc_id, r.text) for r in more.collect()]
    picked = ("row.doc_id", "n_lines", "n_dropped", "kept_text")
    assert rows(drop_common_lines(frame.union(more), grown).select(*picked)) == lines_expected(both, 7)
    back = grown.delete(more)
    assert rows(back.refs()) == rows(store.refs())
    assert rows(drop_common_lines(frame, back).select(*picked)) == lines_expected(LINES, 7)
    with pytest.raises(Exception, match="never inserted"):
        back.delete(more).refs().count()


def test_lines_of_an_empty_table(spark, rows):
    frame = spark.createDataFrame([], DOCS)
    assert rows(drop_common_lines(frame, LineStore.build(frame))) == []


# ---- components


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = labels_of((a, b) for a, b in edges if a is not None and a != b)
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- MinHash


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = minhash.mix64(np.arange(60, dtype=np.uint64))
    w1, w2 = rng.uniform(0.2, 9, 60), rng.uniform(0.2, 9, 60)
    w2[:30] = w1[:30]
    sign = minhash.signatures(np.concatenate([elements, elements]), np.concatenate([w1, w2]), np.array([60, 60]), 4096)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4096)


def jaccard(a, b):
    def bag(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def near_expected(data):
    edges = [(data[i][0], data[j][0]) for i in range(len(data)) for j in range(i + 1, len(data)) if None not in (data[i][0], data[j][0]) and jaccard(data[i][1], data[j][1]) >= 0.8]
    label = labels_of(edges)
    named = [(i, label.get(i, i)) for i, _ in data]
    size = collections.Counter(c for i, c in set(named) if i is not None)
    return sorted([(i, c, size[c] if i is not None else 1, i == c or i is None) for i, c in named], key=str)


def near_data():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    data, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 4, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            data.append((n, " ".join(text)))
            n += 1
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(12):  # each close to the one before it, the ends far apart
        chain = [*chain[3:], *(rng.choice(words) for _ in range(3))]
        data.append((n, " ".join(chain)))
        n += 1
    return [*data, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "Two words"), (n + 4, "two  WORDS"), (n + 5, "the " * 60), (n + 6, "the " * 61), (None, data[0][1]), (3, data[3][1])]


def test_near_copies_equal_brute_force(spark, rows):
    data = near_data()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, component_id string, n int").repartition(4)
    assert rows(minhash.near_dedup(frame)) == near_expected(data)
    assert rows(minhash.near_dedup(frame.limit(0))) == []


# ---- embeddings


def test_embedding_links_equal_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((25, 16))
    vectors = [(centers[rng.integers(25)] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])).tolist() for _ in range(300)]
    data = [(i, v) for i, v in enumerate(vectors)]
    data += [(300, vectors[0]), (301, vectors[0]), (302, [2 * x for x in vectors[1]]), (303, None), (304, []), (305, [0.0] * 16), (306, [float("nan")] * 16), (307, [None] * 16), (308, vectors[2][:8]), (309, [1e300] * 16), (310, [1e300] * 16), (None, vectors[0]), (311, [float("inf"), *vectors[0][1:]])]
    good = [(i, np.array(v)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]

    def cosine(x, y):
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()))

    edges = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[n + 1 :] if len(x) == len(y) and cosine(x, y) >= 0.9]
    degree, label = collections.Counter(x for e in edges for x in e), labels_of(edges)
    expected = sorted([(i, degree[i] if i is not None else 0, label.get(i, i), label.get(i, i) == i or i is None) for i, _ in data], key=str)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, label int, bucket string").repartition(4)
    assert rows(emb.embedding_dedup(frame)) == expected
    assert rows(emb.embedding_dedup(frame.limit(0))) == []


def test_large_buckets_are_compared_block_against_block(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 7)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(12)
    frame = spark.createDataFrame([(i, (center + rng.standard_normal(12) * 0.02).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in emb.embedding_dedup(frame).select("n_links", "component_id").collect()} == {(89, 0)}
