"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A window of ``WINDOW`` bytes is a trigger where its rolling hash is the least within some string of
``size`` bytes, so every string that could be removed holds one (a fixed modulus would leave strings
without). Texts are cut at triggers: a phrase is a stretch of starts whose strings share their least
trigger, with the bytes those strings reach.

1. *Sieve.* Parts of the corpus send the hashes of their triggers; a string can occur in two
   documents only if its trigger does, so all other phrases are done.
2. *Corpus order.* Phrases with repeated triggers go, once per part, to the task of their trigger. It
   cuts them at every occurrence of the trigger, sorts the suffixes of the distinct pieces (the
   dictionary) and the distinct continuations behind triggers (the parse), and merges the two
   orders: neighbours with equal dictionary suffix and a common continuation of the missing length
   start with the same string. Pieces end in their only trigger, so no suffix is a prefix of another.
3. *Removal.* Each part is told which of its phrases start with strings of smaller documents.

Texts are shuffled once (the three visits share the exchange); apart from that only trigger hashes,
phrases with repeated triggers and verdicts move. A trigger with very many different phrases is
spread: its phrases are cut into single strings, which are dealt by their own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import mix64, offsets, ragged

WINDOW = 32
#: Bytes of text that one part holds, and that one bucket of phrases is laid out for.
PART_BYTES = 8 << 20
#: Trigger hashes that one bucket of the sieve is laid out for.
BUCKET_KEYS = 1 << 21
#: Different phrases of a trigger beyond which they are dealt string by string.
HOT = 1 << 15
#: Bytes of text that are hashed together; one longer text is hashed by itself.
SLICE_BYTES = 1 << 19
#: Strings that are sorted together, apart from a trigger with more.
CHUNK = 1 << 18
NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2 ** 64."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(n, base, dtype=np.uint64)
        held[:1] = 1
        np.multiply.accumulate(held, out=held)
        _powers[int(base)] = held
    return held[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the window at every start."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while width < WINDOW and len(h) > width:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
    return mix64(h) if width == WINDOW else h[:0]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from every place on."""
    done = 1
    while done < width and len(h):
        step = min(done, width - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


class Hasher:
    """Hashes of any stretches of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(data) + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[high] - self.sums[low]) * self.back[low] + mix64((high - low).astype(np.uint64)))


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def parse(data: np.ndarray, bounds: np.ndarray, size: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts: first start, end of the starts, trigger, and hash of the bytes they reach.

    Phrases of triggers in ``hot`` (sorted) are cut into one for each start.
    """
    out = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]]
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1)
        base = int(bounds[first])
        part, ends = data[base : int(bounds[last])], bounds[first : last + 1] - base
        first = last
        least = _least(rolling(part), size - WINDOW + 1)
        if not len(least):
            continue
        valid = np.ones(len(part), dtype=bool)
        tail = np.minimum(np.diff(ends), size - 1)
        valid[ragged(ends[1:] - tail, tail)] = False
        valid = valid[: len(least)]
        same = np.zeros(len(least) + 1, dtype=bool)
        same[1:-1] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
        low = np.flatnonzero(valid & ~same[:-1])
        high = np.flatnonzero(valid & ~same[1:]) + 1
        trigger = least[low]
        if len(hot):
            n = np.where(_member(trigger, hot) >= 0, high - low, 1)
            single = np.repeat(n > 1, n)
            high = np.repeat(high, n)
            low, trigger = ragged(low, n), np.repeat(trigger, n)
            high = np.where(single, low + 1, high)
        hashes = Hasher(part).of(low, high + size - 1)
        for held, column in zip(out, (low + base, high + base, trigger, hashes), strict=True):
            held.append(column)
    return tuple(np.concatenate(c) for c in out)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: equal high bytes compress well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _deltas(sorted_numbers: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0)))


def _undelta(data: bytes, kind) -> np.ndarray:
    return np.cumsum(_numbers(data, kind), dtype=kind)


class Texts:
    """The rows of a part in the order of their ids, as one array of bytes."""

    def __init__(self, table: pa.Table):
        texts, ids = table.column("text").to_pylist(), table.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.order = order
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.held = b"".join(texts[i] for i in order)
        self.data = np.frombuffer(self.held, dtype=np.uint8)
        self.bounds = offsets(np.array([len(texts[i]) for i in order], dtype=np.int64))


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KEYS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("info", pa.binary())])
_PHRASES = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary()), ("single", pa.binary()), ("data", pa.binary())])
_VERDICTS = pa.schema([("part", pa.int32()), ("triggers", pa.binary()), ("hashes", pa.binary()), ("lengths", pa.binary()), ("seen", pa.binary())])


def _split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Members of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))
    return [(int(b), order[i:j]) for b, i, j in zip(names, ends, ends[1:], strict=False)]


def _send_triggers(size: int, bits: int):
    """Of a part: its triggers, whether two ids hold them, and how many different phrases they have."""

    def send(key, table):
        texts = Texts(table)
        low, _, trigger, hashes = parse(texts.data, texts.bounds, size, np.zeros(0, dtype=np.uint64))
        ids = texts.ids[np.searchsorted(texts.bounds, low, side="right") - 1]
        spot = mix64(trigger) >> np.uint64(32 - bits)
        order = np.lexsort((hashes, spot))
        spot, hashes, ids = spot[order], hashes[order], ids[order]
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1])) if len(spot) else np.zeros(0, dtype=np.int64)
        columns: list[list] = [[], [], [], []]
        if len(first):
            new = np.append(True, (spot[1:] != spot[:-1]) | (hashes[1:] != hashes[:-1]))
            phrases = np.minimum(np.add.reduceat(new.astype(np.int64), first), (1 << 15) - 1)
            twice = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
            spot = spot[first]
            info = (phrases << 1 | twice).astype(np.uint16)
            for bucket, at in _split((spot >> np.uint64(32)).astype(np.int64)):
                columns[0].append(key[0].as_py())
                columns[1].append(bucket)
                columns[2].append(_deltas((spot[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
                columns[3].append(_planes(info[at]))
        return _table(_KEYS, columns)

    return send


def _find_repeated(hot: int):
    """Of a bucket: the triggers of each part that occur in two documents, and whether they are hot."""

    def find(key, table):
        parts = table.column("part").to_numpy()
        keys = [_undelta(x, np.uint32) for x in table.column("keys").to_pylist()]
        info = np.concatenate([_numbers(x, np.uint16) for x in table.column("info").to_pylist()])
        ends = offsets(np.array([len(k) for k in keys], dtype=np.int64))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        n = np.diff(np.append(first, len(keys)))
        twice = (n > 1) | (np.maximum.reduceat(info[order] & 1, first) > 0)
        many = np.add.reduceat((info[order] >> 1).astype(np.int64), first) > hot
        mark = np.zeros(len(keys), dtype=np.uint8)
        mark[order] = np.repeat(twice + 2 * (twice & many), n)
        columns: list[list] = [[], [], [], []]
        for part, i, j in zip(parts.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
            at = np.flatnonzero(mark[i:j]) + i
            if len(at):
                columns[0].append(part)
                columns[1].append(key[0].as_py())
                columns[2].append(_deltas(keys[at]))
                columns[3].append((mark[at] >> 1).tobytes())
        return _table(_KEYS, columns)

    return find


def _send_phrases(size: int, bits: int, buckets: int):
    """Of a part: its different phrases with repeated triggers, each with the smallest id that holds it."""

    def send(key, table, repeated):
        columns: list[list] = [[] for _ in _PHRASES]
        if not repeated.num_rows or not table.num_rows:
            return _table(_PHRASES, columns)
        known, marks = [], []
        for bucket, keys, mark in zip(*(repeated.column(c).to_pylist() for c in ("bucket", "keys", "info")), strict=True):
            known.append(_undelta(keys, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            marks.append(np.frombuffer(mark, dtype=np.uint8))
        known, marks = np.concatenate(known), np.concatenate(marks)
        order = np.argsort(known)
        known, marks = known[order], marks[order]
        texts = Texts(table)
        none = np.zeros(0, dtype=np.uint64)
        phrases = parse(texts.data, texts.bounds, size, none)
        if marks.any():
            at = _member(mix64(phrases[2]) >> np.uint64(32 - bits), known)
            hot = np.unique(phrases[2][(at >= 0) & (marks[at] > 0)])
            phrases = parse(texts.data, texts.bounds, size, hot)
        low, high, trigger, hashes = phrases
        at = _member(mix64(trigger) >> np.uint64(32 - bits), known)
        use = np.flatnonzero(at >= 0)
        # the first of equal phrases has the smallest id
        use = use[np.sort(np.unique(_name(trigger[use], hashes[use]), return_index=True)[1])]
        low, high, trigger, hashes = low[use], high[use], trigger[use], hashes[use]
        single = marks[at[use]].astype(np.uint8)
        ids = texts.ids[np.searchsorted(texts.bounds, low, side="right") - 1]
        to = (mix64(np.where(single > 0, hashes, trigger) ^ np.uint64(0x5DEECE66D)) % np.uint64(buckets)).astype(np.int64)
        for bucket, mine in _split(to):
            length = high[mine] - low[mine] + size - 1
            held = pa.compress(texts.data[ragged(low[mine], length)].tobytes(), "zstd", asbytes=True)
            row = (key[0].as_py(), bucket, _planes(length.astype(np.uint32)), _deltas(ids[mine]), single[mine].tobytes(), held)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return _table(_PHRASES, columns)

    return send


def _name(trigger: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for a phrase from its two independent hashes."""
    with np.errstate(over="ignore"):
        return mix64(trigger * np.uint64(0xD1342543DE82EF95) + hashes)


def _padded(data: np.ndarray, low: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Stretches of at most ``width`` bytes as fixed byte strings that end in their length."""
    out = np.zeros((len(low), width + 1), dtype=np.uint8)
    inside = np.arange(width) < length[:, None]
    out[:, :width][inside] = data[ragged(low, length)]
    out[:, width] = length + 1
    return out.view(f"S{width + 1}").ravel()


def corpus_order(data: np.ndarray, bounds: np.ndarray, trigger: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all strings of ``size`` bytes in some phrases, and whether each equals the one before.

    ``trigger`` is the hash that all strings of a phrase have as their least. Strings are numbered
    phrase by phrase.
    """
    reach = size - WINDOW
    n = np.diff(bounds) - size + 1
    start = ragged(bounds[:-1], n)
    owner = np.repeat(np.arange(len(n)), np.diff(bounds))
    h = rolling(data)
    place = np.flatnonzero((h == trigger[owner[: len(h)]]) & (owner[: len(h)] == owner[WINDOW - 1 :][: len(h)]))
    # parse: every start belongs to the first trigger from there on
    at = place[np.searchsorted(place, start)]
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
    piece = np.cumsum(np.bincount(head, minlength=len(start))[: len(start)]) - 1
    low, here = start[head], at[head]
    # dictionary: the distinct pieces, and the order of all their suffixes
    _, one, which = np.unique(_padded(data, low, here + WINDOW - low, size), return_index=True, return_inverse=True)
    suffixes = here[one] - low[one] + 1
    first = ragged(low[one], suffixes)
    _, rank = np.unique(_padded(data, first, np.repeat(here[one] + WINDOW, suffixes) - first, size), return_inverse=True)
    left = rank[offsets(suffixes)[:-1][which][piece] + start - low[piece]]
    # parse: the order of what follows behind the triggers
    after = here + WINDOW
    follow = _padded(data, after, np.minimum(reach, bounds[1:][owner[here]] - after), reach)
    follow = follow.view(np.uint8).reshape(-1, reach + 1)[:, :reach] if reach else np.zeros((len(after), 0), dtype=np.uint8)
    keyed = np.ones((len(after), reach + 1), dtype=np.uint8)
    keyed[:, :reach] = follow
    _, some, right = np.unique(keyed.view(f"S{reach + 1}").ravel(), return_index=True, return_inverse=True)
    follow, right = follow[some], right[piece]
    # corpus order: dictionary suffix first, then continuation
    order = np.lexsort((right, left))
    same = np.zeros(len(order), dtype=bool)
    near = np.flatnonzero(left[order][1:] == left[order][:-1])
    a, b = right[order[near]], right[order[near + 1]]
    missing = size - WINDOW - (at - start)[order[near]]
    apart = follow[a] != follow[b]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), reach) if reach else np.zeros(len(near), dtype=np.int64)
    same[near + 1] = common >= missing
    return order, same


def _sort_phrases(size: int):
    """Of a bucket: which phrases of which parts start with strings that smaller ids hold."""

    def sort(key, table):
        length = [_numbers(x, np.uint32).astype(np.int64) for x in table.column("lengths").to_pylist()]
        part = np.repeat(table.column("part").to_numpy(), [len(x) for x in length])
        ids = np.concatenate([_undelta(x, np.int64) for x in table.column("ids").to_pylist()])
        single = np.frombuffer(b"".join(table.column("single").to_pylist()), dtype=np.uint8) > 0
        packed = zip(table.column("data").to_pylist(), length, strict=True)
        data = np.frombuffer(b"".join(pa.decompress(x, int(n.sum()), "zstd", asbytes=True) for x, n in packed), dtype=np.uint8)
        bounds = offsets(np.concatenate(length))
        hashes, trigger = np.zeros((2, len(ids)), dtype=np.uint64)
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1)
            piece, ends = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
            hashes[first:last] = Hasher(piece).of(ends[:-1], ends[1:])
            trigger[first:last] = _least(rolling(piece), size - WINDOW + 1)[ends[:-1]]
            first = last
        # equal phrases are sorted once
        order = np.lexsort((ids, hashes, trigger))
        new = np.append(True, (trigger[order][1:] != trigger[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))
        group = np.cumsum(new) - 1
        lead = order[new]
        strings = bounds[lead + 1] - bounds[lead] - size + 1
        upto = offsets(strings)
        turn = np.flatnonzero(np.append(True, trigger[lead][1:] != trigger[lead][:-1]))
        columns: list[list] = [[] for _ in _VERDICTS]
        found: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(lead):
            # whole triggers, about CHUNK strings together
            to = int(np.searchsorted(upto, upto[at] + CHUNK, side="right")) - 1
            fit = int(np.searchsorted(turn, max(at + 1, to), side="right")) - 1
            to = int(turn[fit]) if turn[fit] > at else (int(turn[fit + 1]) if fit + 1 < len(turn) else len(lead))
            mine, n = lead[at:to], strings[at:to]
            length_ = n + size - 1
            ends = offsets(n)
            sequence, same = corpus_order(data[ragged(bounds[mine], length_)], offsets(length_), trigger[mine], size)
            least = np.repeat(ids[mine], n)[sequence]
            heads = np.flatnonzero(~same)
            smallest = np.empty(len(sequence), dtype=np.int64)
            smallest[sequence] = np.repeat(np.minimum.reduceat(least, heads), np.diff(np.append(heads, len(sequence))))
            # every part compares with its own smallest id
            rows = np.arange(np.searchsorted(group, at), np.searchsorted(group, to))
            phrase = group[rows] - at
            seen = smallest[ragged(ends[phrase], n[phrase])] < np.repeat(ids[order[rows]], n[phrase])
            reach = offsets(n[phrase])
            some = np.add.reduceat(seen, reach[:-1], dtype=np.int64) > 0
            keep = np.flatnonzero(some | single[order[rows]])
            found.append((order[rows[keep]], n[phrase[keep]], seen[ragged(reach[keep], n[phrase[keep]])]))
            at = to
        at, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        seen, reach = np.concatenate([f[2] for f in found]), offsets(n)
        for name, mine in _split(part[at]):
            hot = np.where(single[at[mine]], np.uint32(1 << 31), np.uint32(0))
            row = (name, trigger[at[mine]].tobytes(), hashes[at[mine]].tobytes(), _planes(n[mine].astype(np.uint32) | hot), seen[ragged(reach[mine], n[mine])].tobytes())
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return _table(_VERDICTS, columns)

    return sort


def _remove(size: int, schema: pa.Schema, with_text: bool, with_digests: bool):
    """Of a part: cut what smaller ids hold, by the verdicts and by what the part itself repeats."""

    def remove(key, table, verdicts):
        columns: list[list] = [[] for _ in schema]
        if not table.num_rows:
            return _table(schema, columns)
        texts = Texts(table)
        joined = [b"".join(verdicts.column(c).to_pylist()) for c in ("triggers", "hashes", "seen")]
        trigger, hashes = (np.frombuffer(x, dtype=np.uint64) for x in joined[:2])
        seen = np.frombuffer(joined[2], dtype=bool)
        n = np.concatenate([np.zeros(0, dtype=np.uint32), *(_numbers(x, np.uint32) for x in verdicts.column("lengths").to_pylist())])
        hot = np.unique(trigger[n >> 31 > 0])
        n = (n & np.uint32((1 << 31) - 1)).astype(np.int64)
        told, reach = _name(trigger, hashes), offsets(n)
        by = np.argsort(told)

        low, high, trigger, hashes = parse(texts.data, texts.bounds, size, hot)
        ids = texts.ids[np.searchsorted(texts.bounds, low, side="right") - 1]
        names, first, which = np.unique(_name(trigger, hashes), return_index=True, return_inverse=True)
        later = ids > ids[first][which]
        at = _member(names, told[by])[which]
        asked = np.flatnonzero(~later & (at >= 0))
        answer = by[at[asked]]
        spot = ragged(low[asked], n[answer])[seen[ragged(reach[answer], n[answer])]]
        change = np.zeros(len(texts.data) + 1, dtype=np.int32)
        np.add.at(change, low[later], 1)
        np.add.at(change, high[later] + size - 1, -1)
        np.add.at(change, spot, 1)
        np.add.at(change, spot + size, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = offsets(gone.astype(np.int64))[texts.bounds]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        whole = texts.bounds[:-1][np.diff(texts.bounds) > 0]
        edge[whole] = gone[whole]
        heads = np.flatnonzero(edge)
        spans = np.searchsorted(heads, texts.bounds)
        kept = texts.data[~gone].tobytes()
        stay = (texts.bounds - total).tolist()
        stops = np.searchsorted(np.flatnonzero(~gone), heads)
        ends = np.append(np.flatnonzero(~gone), len(gone))[stops] if len(heads) else heads
        source = table.column("source").to_pylist()
        for i, row in enumerate(texts.order):
            size_, cut = int(texts.bounds[i + 1] - texts.bounds[i]), int(total[i + 1] - total[i])
            values = [source[row], size_, cut, int(spans[i + 1] - spans[i])]
            text = kept[stay[i] : stay[i + 1]]
            if with_text:
                base, a, b = int(texts.bounds[i]), int(spans[i]), int(spans[i + 1])
                last = int(texts.bounds[i + 1])
                values += [[{"start": int(s) - base, "end": min(int(e), last) - base} for s, e in zip(heads[a:b], ends[a:b], strict=True)], text]
            if with_digests:
                values.append(hashlib.sha256(text).hexdigest())
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return _table(schema, columns)

    return remove


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = True, with_digests: bool = False,
    part_bytes: int = PART_BYTES, hot: int = HOT,
) -> DataFrame:
    """``<id_col>``, ``n_bytes``, ``n_removed``, ``n_spans`` and, as asked for, ``spans`` and ``kept``
    (binary) or ``kept_sha256``: one row per input row.

    Texts are UTF-8 bytes. A byte is removed if a string of ``size`` bytes covers it that also starts
    in a row with a smaller id; strings are judged on the input and never cross rows. Ids are whole
    numbers. Rows that share an id don't remove from one another; a row without an id loses to every
    row with one and takes from none. Null and empty texts, and texts of fewer than ``size`` bytes,
    lose nothing. An empty table gives an empty result. Other columns are ignored, whatever their
    names; the id's own name must not be one of the result's.

    Parts hold about ``part_bytes`` of text (a longer text is a part's own burden); grow them with the
    corpus, so that parts and buckets stay of like number. ``size`` must be at least ``WINDOW``. A
    phrase is told from others by 128 bits of hash; strings themselves are compared by their bytes.
    """
    own = ["n_bytes", "n_removed", "n_spans", *(["spans", "kept"] if with_text else []), *(["kept_sha256"] if with_digests else [])]
    if id_col in own:
        raise ValueError(f"{id_col} is a column of the result")
    if size < WINDOW:
        raise ValueError(f"strings of fewer than {WINDOW} bytes have no trigger")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    bits = min(24, max(0, (2 * total // (size - WINDOW + 2) // BUCKET_KEYS)).bit_length())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col(id_col).alias("source"), key.alias("id"), text.alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))

    keys = "part int, bucket int, keys binary, info binary"
    triggers = rows.groupBy("part").applyInArrow(_send_triggers(size, bits), keys)
    repeated = triggers.groupBy("bucket").applyInArrow(_find_repeated(hot), keys)
    phrases = rows.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(
        _send_phrases(size, bits, parts), "part int, bucket int, lengths binary, ids binary, single binary, data binary"
    )
    verdicts = phrases.groupBy("bucket").applyInArrow(_sort_phrases(size), "part int, triggers binary, hashes binary, lengths binary, seen binary")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in own[:3]]]
    arrow = [(id_col, _ARROW[docs.schema[id_col].dataType.typeName()]), *[(c, pa.int64()) for c in own[:3]]]
    if with_text:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        fields += [T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]
        arrow += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    if with_digests:
        fields.append(T.StructField("kept_sha256", T.StringType()))
        arrow.append(("kept_sha256", pa.string()))
    return rows.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(_remove(size, pa.schema(arrow), with_text, with_digests), T.StructType(fields))


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "byte": pa.int8()}
