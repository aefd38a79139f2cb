"""Periodic runs on the grammar against a scan of every period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm.periodic_runs import find_runs, periodic_runs
from spindrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(x, least, power):
    """Maximal stretches of every period, each with its smallest period only."""
    found = {}
    for q in range(1, len(x) // power + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def row(doc_id, words, runs):
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers), "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept)


block = st.builds(lambda w, k, cut: (w * k)[:cut], st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 7), st.integers(1, 80))
word_list = st.builds(lambda parts, twice: sum(parts, []) * (1 + twice), st.lists(block, max_size=5), st.booleans())


@settings(max_examples=400, deadline=None)
@given(st.lists(word_list, min_size=1, max_size=5), st.sampled_from([(24, 3), (6, 2), (9, 3), (5, 2)]))
def test_runs_equal_brute_force(texts, limits):
    got = find_runs(np.array(sum(texts, []), dtype=np.int64), np.cumsum([0, *map(len, texts)]), *limits)
    assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute(t, *limits)]


def test_a_long_text_of_one_word_and_nested_periods():
    x = [7] * 50000
    inner = ([1] * 30 + [2, 3]) * 40
    got = find_runs(np.array(x + inner), np.array([0, len(x), len(x) + len(inner)]))
    assert got[0].tolist() == [0, 0, 50000, 1] and len(got) == 1 + 40 + 1
    assert [1, 0, len(inner), 32] in got.tolist()


ODD = [None, "", "  \n", "a", "x " * 24, "x " * 23, "a b c " * 8, "ab\x0bcd\x0cef\r" * 9 + "end", "é 漢 字 🙂 " * 12, "p " + "q r s t " * 5000]


def test_odd_rows_and_columns(spark):
    rows = [*enumerate(ODD), (3, "again " * 30), (3, "again " * 30), (None, "z " * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_runs int")
    got = periodic_runs(docs, with_digests=True).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append(row(i, words, brute(words, 24, 3)))
    assert len(got) == len(rows)
    plain = [((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli), "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs), r.collapsed) for r in got]
    assert sorted(plain, key=str) == sorted(want, key=str)
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in got)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        numbers, listed, kept = row(r.doc_id, words, brute(words, 24, 3))
        assert tuple(r) == (*numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_runs for r in got) > 10
