"""Fill-in-middle against code-point slicing in plain Python."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import fill_in_middle as fim
from spindrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (len(text), "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "a", "é", "naïve 漢字 🙂🙂 end", "<P>", "x<M>y", "<", "<S", "S>P>M>", "<<<S", "🙂" * 3000, "word " * 40000, "\x00\x00", "á﻿"]


def test_odd_texts_and_ids(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 8)] + [(None, "abc"), (3, "again"), (3, "again"), (-7, "négatif")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, form string")
    got = fim.fill_in_middle(docs, with_digests=True).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *expected(i, t), sha(expected(i, t)[4]), sha(t or "")) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab<PSM>é漢🙂", max_size=30), min_size=1, max_size=6), st.integers(0, 30), st.integers(0, 30))
def test_index_cuts_like_code_points_and_outputs_restore(texts, a, b):
    import numpy as np

    coded = [t.encode() for t in texts]
    index = fim.ExceptionIndex.build(np.frombuffer(b"".join(coded), dtype=np.uint8), np.cumsum([0, *map(len, coded)]))
    assert index.points().tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        x, y = sorted((min(a, len(t)), min(b, len(t))))
        cut = index.byte_of(np.array([i, i]), np.array([x, y])) - index.first_byte[i]
        assert cut.tolist() == [len(t[:x].encode()), len(t[:y].encode())]
        if not any(m in t for m in ("<P>", "<S>", "<M>")):
            for form in ("psm", "spm", "plain"):
                out = fim.assemble(form, t[:x].encode(), t[x:y].encode(), t[y:].encode())
                assert fim.restore(form, out).decode() == t


def test_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_fill_in_middle"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = expected(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, *want[:4], sha(want[4]), sha(docs[r.doc_id] or ""))
