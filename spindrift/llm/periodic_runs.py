"""Periodic runs of words, found on a Re-Pair grammar.

A run is a maximal stretch of words with smallest period q that is at least ``least`` words and
``power * q`` words long. Windows of words that occur once in a text can't lie in a run, so only
stretches covered by repeated windows get a grammar. Re-Pair replaces frequent pairs of symbols by
nonterminals until no pair repeats. The smallest node of the derivation that holds a run is crossed
by it at the boundary of its two parts, so for every nonterminal, once, the runs across its boundary
are computed (periods q for which the words on both sides agree, extended both ways); then they are
translated to every place the nonterminal derives, and stretches inside longer ones of the same
period are merged into them. All texts of a slice go through these steps together, in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import mix64, offsets, ragged

#: Words that are searched together; one longer text is searched by itself.
SLICE_WORDS = 1 << 19
#: Pairs of a boundary and a period that are looked at together.
CANDIDATES = 1 << 20
Plant = Callable[[object, int], tuple[int, int] | None]


def _repeated(words: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Whether a word lies in a window of ``size`` words that occurs again in its text."""
    n = len(words)
    covered = np.zeros(n + 1, dtype=np.int32)
    if n >= size:
        h = mix64(words.astype(np.uint64))
        with np.errstate(over="ignore"):
            width, out = 1, h
            total = np.zeros(n - size + 1, dtype=np.uint64)
            at, left = 0, size
            while left:
                if left & 1:
                    total = mix64(total + out[at : at + len(total)])
                    at += width
                left >>= 1
                if left:
                    out = mix64(out[:-width] * np.uint64(3) + out[width:])
                    width *= 2
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(total)]
            inside = np.arange(len(total)) + size <= bounds[1:][text]
            start = np.flatnonzero(inside)
            key = mix64(total[start] + mix64(text[start].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, start[again], 1)
        np.add.at(covered, start[again] + size, -1)
    return np.cumsum(covered[:-1]) > 0


class Grammar:
    """Re-Pair over several texts at once; symbols are distinct between texts.

    In a round every text replaces the pairs that are at least half as frequent as its most
    frequent one; where chosen pairs overlap the more frequent wins, ties by symbol. ``rule`` and
    ``place`` list every place (index of its first word) that a nonterminal derives.
    """

    def __init__(self, symbols: np.ndarray, text: np.ndarray, stretch: np.ndarray):
        n = len(symbols)
        sym, at = symbols.astype(np.int64), np.arange(n)
        size = np.ones(n, dtype=np.int64)
        first_rule = int(sym.max()) + 1 if n else 0
        next_rule = first_rule
        cut, length, rules, places = [], [], [], []
        done_at, done_size = [], []
        while len(sym):
            joint = np.zeros(len(sym), dtype=bool)
            joint[:-1] = stretch[at[:-1]] == stretch[at[1:]]
            i = np.flatnonzero(joint)
            pair = sym[i] << 32 | sym[i + 1]
            names, code, count = np.unique(pair, return_inverse=True, return_counts=True)
            of = text[at[i]]
            most = np.zeros(int(text.max()) + 1, dtype=np.int64)
            np.maximum.at(most, of, count[code])
            finished = most[text[at]] < 2
            done_at.append(at[finished])
            done_size.append(size[finished])
            # rank of a pair among all: the more frequent first
            rank = np.empty(len(names), dtype=np.int64)
            rank[np.lexsort((-np.arange(len(names)), count))] = np.arange(1, len(names) + 1)
            worth = np.zeros(len(sym) + 1, dtype=np.int64)
            wanted = (count[code] >= 2) & (2 * count[code] >= most[of])
            worth[i[wanted]] = rank[code[wanted]]
            w = worth[:-1]
            # equal neighbours are a row of one symbol: every other one of the row is replaced
            head = np.ones(len(w), dtype=bool)
            head[1:] = w[1:] != w[:-1]
            row = np.cumsum(head) - 1
            row_at = np.flatnonzero(head)
            before = np.where(row_at > 0, w[row_at - 1], 0)
            after = np.append(w[row_at[1:]], 0)
            best = (w[row_at] > before) & (w[row_at] > after)
            take = best[row] & ((np.arange(len(w)) - row_at[row]) % 2 == 0) & (w > 0)
            chosen = np.flatnonzero(take)
            if len(chosen):
                made, first, which = np.unique(w[chosen], return_index=True, return_inverse=True)
                name = next_rule + which
                lead = chosen[first]
                cut.append(size[lead])
                length.append(size[lead] + size[lead + 1])
                rules.append(name)
                places.append(at[chosen])
                next_rule += len(made)
                sym[chosen] = name
                size[chosen] += size[chosen + 1]
            stay = ~finished
            stay[chosen + 1] = False
            sym, at, size = sym[stay], at[stay], size[stay]
        none = np.zeros(0, dtype=np.int64)
        self.cut = np.concatenate([none, *cut])
        self.length = np.concatenate([none, *length])
        self.rule = np.concatenate([none, *rules]) - first_rule
        self.place = np.concatenate([none, *places])
        at, size = np.concatenate([none, *done_at]), np.concatenate([none, *done_size])
        order = np.argsort(at)
        #: places and sizes of the symbols that are left
        self.start, self.size = at[order], size[order]


class Words:
    """Exact comparison of stretches of words: names of all windows of 1, 2, 4, ... words."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [symbols.astype(np.int64)]
        width = 1
        while 2 * width <= longest:
            low = self.names[-1]
            n = len(low) - width
            pair = low[:n] << 32 | low[width:]
            self.names.append(np.unique(pair, return_inverse=True)[1])
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on, at most ``limit``."""
        return self._agree(i, j, limit, 1)

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree up to and with ``i`` and ``j``, at most ``limit``."""
        return self._agree(i, j, limit, -1)

    def _agree(self, i, j, limit, way):
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            width, names = 1 << k, self.names[k]
            # the widest window may fit more than once
            for _ in range(1 if k + 1 < len(self.names) else 2):
                open_ = np.flatnonzero(done + width <= limit)
                d = done[open_]
                a, b = (i[open_] + d, j[open_] + d) if way > 0 else (i[open_] - d - width + 1, j[open_] - d - width + 1)
                same = names[a] == names[b]
                done[open_[same]] += width
        return done


def _crossing(words: Words, low: np.ndarray, mid: np.ndarray, high: np.ndarray, least: int, power: int):
    """(node, start, end, period) of the runs within [low, high) across ``mid``, smallest period each."""
    x = words.names[0]
    most = (high - low) // power
    ends = offsets(most)
    found = []
    for first in range(0, int(ends[-1]), CANDIDATES):
        at = np.arange(first, min(int(ends[-1]), first + CANDIDATES))
        node = np.searchsorted(ends, at, side="right") - 1
        q = at - ends[node] + 1
        u, b, v = low[node], mid[node], high[node]
        # the run holds the q words after the boundary, or the q words in front of it
        right = np.flatnonzero(b + q <= v)
        right = right[x[b[right] - 1] == x[b[right] - 1 + q[right]]]
        left = np.flatnonzero(b - q >= u)
        left = left[x[b[left]] == x[b[left] - q[left]]]
        r, s = right, left
        start = b[r] - words.backward(b[r] - 1, b[r] + q[r] - 1, b[r] - u[r])
        end = b[r] + q[r] + words.forward(b[r], b[r] + q[r], v[r] - b[r] - q[r])
        start2 = b[s] - q[s] - words.backward(b[s] - 1, b[s] - q[s] - 1, b[s] - q[s] - u[s])
        end2 = b[s] + words.forward(b[s], b[s] - q[s], v[s] - b[s])
        k, s0, e0 = np.append(r, s), np.append(start, start2), np.append(end, end2)
        keep = e0 - s0 >= np.maximum(least, power * q[k])
        found.append(np.column_stack([node[k][keep], s0[keep], e0[keep], q[k][keep]]))
    runs = np.concatenate([np.zeros((0, 4), dtype=np.int64), *found])
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    return runs[new]


def _halves(start: np.ndarray, size: np.ndarray, stretch: np.ndarray, least: int):
    """Nodes over the symbols that are left of each stretch, halved again and again."""
    heads = np.flatnonzero(np.append(True, stretch[start[1:]] != stretch[start[:-1]])) if len(start) else np.zeros(0, dtype=np.int64)
    lo, hi = heads, np.append(heads[1:], len(start)) if len(start) else heads
    ends = start + size
    nodes = []
    while len(lo):
        use = (hi - lo >= 2) & (ends[hi - 1] - start[lo] >= least)
        lo, hi = lo[use], hi[use]
        mid = (lo + hi) // 2
        nodes.append(np.column_stack([start[lo], start[mid], ends[hi - 1]]))
        lo, hi = np.append(lo, mid), np.append(mid, hi)
    return np.concatenate([np.zeros((0, 3), dtype=np.int64), *nodes])


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = 24, power: int = 3) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period.

    ``words`` are numbers of the words of all texts, ``bounds`` the starts of the texts and the end
    of the last; starts count words of the text.
    """
    shared = -(-least * (power - 1) // power)
    covered = _repeated(words, bounds, shared)
    held = np.flatnonzero(covered)
    if not len(held):
        return np.zeros((0, 4), dtype=np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[held]
    stretch = np.cumsum(np.append(True, (np.diff(held) > 1) | (np.diff(text) > 0)))
    symbols = np.unique(text << 32 | words[held], return_inverse=True)[1]
    grammar = Grammar(symbols, text, stretch)
    compare = Words(symbols, int(np.bincount(stretch).max()))

    # every nonterminal is looked at where it derives first
    order = np.argsort(grammar.rule, kind="stable")
    rule, place = grammar.rule[order], grammar.place[order]
    begin = np.searchsorted(rule, np.arange(len(grammar.length)))
    long_ = np.flatnonzero(grammar.length >= least)
    low = place[begin[long_]]
    runs = _crossing(compare, low, low + grammar.cut[long_], low + grammar.length[long_], least, power)
    # ... and its runs hold wherever it derives
    node = long_[runs[:, 0]]
    times = np.append(begin[1:], len(rule))[node] - begin[node]
    moved = np.repeat(runs[:, 1:3] - low[runs[:, 0]][:, None], times, axis=0) + place[ragged(begin[node], times)][:, None]
    everywhere = np.column_stack([moved, np.repeat(runs[:, 3], times)])
    top = _halves(grammar.start, grammar.size, stretch, least)
    last = _crossing(compare, top[:, 0], top[:, 1], top[:, 2], least, power)[:, 1:]
    return _merged(np.concatenate([everywhere, last]), held, text, bounds)


def _merged(runs: np.ndarray, held: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Drop stretches that lie in others of the same period; name the rest by text and word."""
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    if not len(runs):
        return np.zeros((0, 4), dtype=np.int64)
    # ends are compared within a period only, as later periods start beyond all ends
    reach = runs[:, 1] + runs[:, 2] * (int(runs[:, 1].max()) + 1)
    whole = np.ones(len(runs), dtype=bool)
    whole[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    runs = runs[whole]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    of = text[runs[:, 0]]
    out = np.column_stack([of, held[runs[:, 0]] - bounds[of], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _slices(texts: list[bytes], plant: Plant | None, ids: list):
    """(first, last, words of each text) of consecutive texts of about ``SLICE_WORDS`` words."""
    first, held, lists = 0, 0, []
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        planted = plant(ids[i], n) if plant else None
        if planted:
            a, p = planted
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        lists.append(words)
        held += n
        if held >= SLICE_WORDS or i + 1 == len(texts):
            yield first, i + 1, lists
            first, held, lists = i + 1, 0, []


def _search(names: list[str], least: int, power: int, plant: Plant | None, with_text: bool, with_digests: bool):
    def search(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, last, lists in _slices(b.column(1).to_pylist(), plant, ids):
                bounds = offsets(np.array([len(w) for w in lists], dtype=np.int64))
                coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
                found = find_runs(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, least, power)
                ends = np.searchsorted(found[:, 0], np.arange(len(lists) + 1)).tolist()
                rows = found[:, 1:].tolist()
                best, listed, kept = [], [], []
                for words, i, j in zip(lists, ends, ends[1:], strict=False):
                    mine = rows[i:j]
                    listed.append(mine)
                    best.append(min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None))
                    if mine:
                        drop = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, n, q in mine:
                            drop[s + q] += 1
                            drop[s + n] -= 1
                        words = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
                    kept.append(b" ".join(words))
                numbers = [[r[k] if r else None for r in best] for k in range(3)]
                numbers.append([1000 * r[1] // r[2] if r else None for r in best])
                columns = [b.column(0).slice(first, last - first), pa.array([len(m) for m in listed], pa.int64()), *[pa.array(c, pa.int64()) for c in numbers]]
                if with_text:
                    columns.append(pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in m] for m in listed], _RUNS))
                    columns.append(pa.array(kept, pa.binary()))
                if with_digests:
                    lines = ["".join(f"{s},{n},{q}\n" for s, n, q in m).encode() for m in listed]
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()) for data in (lines, kept)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return search


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, power: int = 3,
    plant: Plant | None = None, with_text: bool = True, with_digests: bool = False,
) -> DataFrame:
    """One row per input row: ``<id_col>``, ``n_runs``, then ``start``, ``length``, ``period`` and
    ``exponent_milli`` of the run with the greatest length by period (ties: smallest start, then
    period); with ``with_text`` also ``runs`` (all of them) and ``collapsed`` (the words that no run
    holds after its first period, joined by one space); with ``with_digests`` ``runs_sha256`` and
    ``collapsed_sha256``.

    Words are separated by ASCII white space. ``plant(id, n)`` may name ``(a, p)``: words from a on
    then repeat with period p before the search. Null, empty and white-space texts have no words,
    no runs and four nulls, and collapse to an empty text. Rows don't meet: ids may repeat or be null.
    An empty table gives an empty result. Other columns are ignored, whatever their names; the id's
    own name must not be one of the result's. Texts of any length are searched whole; a long one is
    a slice by itself, and work grows with n log n.
    """
    own = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256")
    if id_col in own:
        raise ValueError(f"{id_col} is a column of the result")
    chosen = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    fields = [T.StructField(c, T.LongType()) for c in own[:5]]
    if with_text:
        run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
        fields += [T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.BinaryType())]
    if with_digests:
        fields += [T.StructField(c, T.StringType()) for c in own[7:]]
    schema = T.StructType([chosen.schema[0], *fields])
    found = chosen.mapInArrow(_search(schema.names, least, power, plant, with_text, with_digests), schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string")) if with_text else found
