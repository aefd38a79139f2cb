"""Encoding, decoding and packing against the tokenizers library and plain Python."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bpe, packing
from spindrift.llm.queries import vocabulary

DOCS = "doc_id long, text string"
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "it's we'll 'S", "x" * 3000, "ab" * 2000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "<|endof text|>", "1234 5678\t9", "naïve café 漢字 🙂🙂", " x  y z", "\x1c \x85 ​﻿", "word " * 4000, "  " * 500 + "end",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(vocabulary())


def same(encoder, library, texts):
    ids, counts = encoder.encode_batch(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ends = np.append(0, np.cumsum(counts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == expected
    assert [t.decode("utf-8", "replace") for t in encoder.decode(ids, counts)] == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_odd_texts(encoder, library):
    same(encoder, library, ODD)
    same(encoder, library, [])


def test_every_token_and_random_joins_of_tokens(encoder, library):
    rng = random.Random(1)
    words = [library.decode([i], skip_special_tokens=False) for i in range(0, 50257)]
    same(encoder, library, words)
    same(encoder, library, ["".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(3000)])
    same(encoder, library, ["".join(rng.choices("ab 's \n\té1漢<|", k=rng.randint(0, 40))) for _ in range(3000)])


def test_the_pair_table_may_start_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 50)
    rng = random.Random(2)
    same(encoder, library, ["".join(rng.choices("abcdefgh", k=30)) for _ in range(300)])


def test_letters_and_signs_need_no_rule(encoder, library, monkeypatch):
    """Plain words are cut without a call of the splitting rule each; the others as the rule says."""
    asked = []

    class Rule:
        def findall(self, piece, plain=encoder.words):
            asked.append(piece)
            return plain.findall(piece)

    monkeypatch.setattr(encoder, "words", Rule())
    words = ["plain", "naïve,", "Ünder...", "it's", "'s", "don't!", "a_b", "_", "(x)", "x2", "2x", "漢字", "a\u0301b", "ªº", "×÷", "end.\nNext", "ÿĀɏɐ", "ok\u2026", "$$$", "''s", "I'll,"]
    rng = random.Random(6)
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(50)] + ["", " ", "word ", " word", "word.", ".", "a  b", "a<|endoftext|>b", "a <|endoftext|> b"]
    ids, counts = encoder.encode_batch(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {" plain", " naïve,", " Ünder...", "plain"} & set(asked) and " end.\nNext" in asked


def test_decoding_broken_ids_gives_replacement_characters(spark):
    frame = spark.createDataFrame([(1, struct.pack("<2I", 200, 72)), (2, None), (3, b"")], "doc_id long, ids binary")
    got = [r.decoded for r in bpe.decode(frame, vocabulary()).orderBy("doc_id").collect()]
    assert got == [Tokenizer.from_file(vocabulary()).decode([200, 72]), "", ""]


def test_encode_rows(spark, library):
    data = [(i, t) for i, t in enumerate([*ODD, None])] + [(3, ODD[9]), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in data], DOCS + ", n int").repartition(3)
    got = bpe.encode(frame, vocabulary(), decode=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in got) == sorted(
        (i is None, i or 0, len(e := library.encode(t or "", add_special_tokens=False).ids), struct.pack(f"<{len(e)}I", *e), t or "") for i, t in data
    )
    assert bpe.encode(frame.limit(0), vocabulary()).collect() == []


# ---- packing


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_and_are_nearly_full(seed):
    rng = random.Random(seed)
    capacity = 256
    histogram = {}
    for _ in range(rng.choice([1, 40, 3000, 20000])):
        n = min(capacity, max(1, int(rng.expovariate(1 / 60)))) if seed % 2 else rng.randint(1, capacity)
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.plan(histogram, capacity)
    held = {}
    for config, n in plan:
        assert n > 0 and sum(length * times for length, times in config) <= capacity
        for length, times in config:
            held[length] = held.get(length, 0) + n * times
    assert held == histogram
    sequences, least = sum(n for _, n in plan), -(-sum(k * v for k, v in histogram.items()) // capacity)
    lengths = np.array(sorted(histogram))
    greedy = sum(packing._best_fit(lengths, np.array([histogram[int(x)] for x in lengths]), capacity).values())
    assert sequences <= max(greedy, int(least * 1.01) + 1)


def test_the_program_itself_covers_nearly_everything():
    rng = np.random.default_rng(3)
    lengths, demand = np.unique(rng.integers(1, 257, 20000), return_counts=True)
    counts = packing.configuration_lp(lengths, demand, 256)
    used = sum(x * sum(lengths[i] * t for i, t in c) for c, x in counts.items())
    assert used >= 0.98 * (lengths * demand).sum()
    assert sum(counts.values()) <= (lengths * demand).sum() / 256 * 1.01


def test_lengths_that_do_not_fit_together_are_packed_exactly():
    assert sum(n for _, n in packing.plan({6: 100}, 10)) == 100
    assert sum(n for _, n in packing.plan({6: 100, 4: 100}, 10)) == 100
    assert sum(n for _, n in packing.plan({5: 101}, 10)) == 51
    assert packing.plan({}, 10) == []


def test_packed_documents(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)
    data = [(i, t) for i, t in enumerate([*ODD, None])] + [(i, "same text") for i in range(100, 140)] + [(100, "same text"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in data], DOCS + ", length int").repartition(4)
    got = packing.pack_documents(frame, vocabulary(), capacity=64, with_ids=True).collect()
    expected = []
    for i, t in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 64 or 64
        cuts = [0] if len(ids) <= 64 else [0, *range(head, len(ids), 64)]
        for k, a in enumerate(cuts):
            raw = struct.pack(f"<{len(part := ids[a : [*cuts, len(ids)][k + 1]])}I", *part)
            expected.append((i, k, a, len(part), zlib.crc32(raw), raw))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(expected, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 64
    assert packing.pack_documents(frame.limit(0), vocabulary()).collect() == []


def test_sequences_join_their_pieces(spark):
    rows = [(1, 0, b"\x01\0\0\0"), (1, 1, b"\x02\0\0\0\x03\0\0\0"), (2, 0, b"\x04\0\0\0")]
    frame = spark.createDataFrame(rows, "sequence_id long, offset long, ids binary").orderBy(F.desc("offset"))
    assert {r.sequence_id: bytes(r.ids) for r in packing.sequences(frame).collect()} == {1: b"\x01\0\0\0\x02\0\0\0\x03\0\0\0", 2: b"\x04\0\0\0"}
