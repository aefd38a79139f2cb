"""Random forests of many deep trees without a histogram of every node.

A node with many rows gets its split from histograms that tasks add up and one group a tree sums
(level by level, as in ``boosting``). As soon as a node holds ``LOCAL_ROWS`` rows at most, one task
grows the subtree below. Such a task reads the stored table block by block and keeps the rows that
its nodes drew, so no row is shuffled or written for a tree. A tree that would need more than
``READS`` such tasks gets smaller subtrees (``DEALT_ROWS``) instead, whose rows are shuffled to one group
a node. Counts are whole numbers, draws and feature choices are hashes of (row, tree) and (tree,
node): where a subtree is grown changes nothing about it.

A row is a record of its bins, its class and its weight, a few bytes in a fixed place each; rows
of a node lie next to each other, so that a level reads them in order.

Splits are those of MLlib's forests: Gini, the square root of the number of features a node (all for
one tree), Poisson weights, all subsets of a short category, longer ones in the order of impurity, and
siblings that predict the same class are one leaf.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, e, factorial, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import bounded_batches
from spindrift.ml.boosting import Trees, _edges, _value
from spindrift.sources import workdir

#: Rows of all nodes whose subtrees one task grows from the stored table, and tasks of a tree that do so at most.
LOCAL_ROWS = 1 << 25
READS = 8
#: Rows of a node whose subtree one group grows from shuffled rows.
DEALT_ROWS = 1 << 20
# fixed values: a category of at most so many codes is tried in all subsets; rows of a turn and of a task at once
SHORT = 7
TURN = 1 << 17
BLOCK = 1 << 16
# rows for each bin from which bins without rows are not looked for
DENSE = 4
_POISSON = np.searchsorted(np.cumsum([65536 / e / factorial(k) for k in range(9)]), np.arange(65536) + 0.5).astype(np.uint8)


class Tree(NamedTuple):
    """Nodes in the order of a full binary tree: the split feature (-1: leaf), its last left bin or the
    row of ``masks`` (a bit a code that goes left), the left child (the right one follows) or the row
    of ``counts`` (weights of the classes in a leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    masks: np.ndarray
    counts: np.ndarray


@dataclass
class Forest:
    features: tuple[str, ...]
    categories: dict[str, list[str]]
    edges: list[np.ndarray]
    outputs: tuple[str, ...]
    gain: np.ndarray
    trees: list[Tree]

    def importance(self) -> dict[str, float]:
        """Mean over the trees of each feature's share of what the splits have saved."""
        total = self.gain.sum()
        names = [f"{f}_code" if f in self.categories else f for f in self.features]
        return dict(zip(names, (self.gain / total if total else self.gain).tolist(), strict=True))

    def to_parts(self) -> list[bytes]:
        """What all trees share, then a part for every tree."""
        head = {f"edges{i}": x for i, x in enumerate(self.edges)} | {"gain": self.gain}
        head |= {"features": np.array(self.features, dtype=str), "outputs": np.array(self.outputs, dtype=str)}
        head |= {f"category{self.features.index(f)}": np.array(v, dtype=str) for f, v in self.categories.items()}
        return [_packed(head), *[_packed(t._asdict()) for t in self.trees]]

    @classmethod
    def from_parts(cls, parts: Sequence[bytes]) -> Forest:
        head = np.load(io.BytesIO(parts[0]), allow_pickle=False)
        features = tuple(head["features"].tolist())
        known = {features[int(k[8:])]: head[k].tolist() for k in head.files if k.startswith("category")}
        held = [np.load(io.BytesIO(p), allow_pickle=False) for p in parts[1:]]
        edges = [head[f"edges{i}"] for i in range(len(features))]
        return cls(features, known, edges, tuple(head["outputs"].tolist()), head["gain"], [Tree(*[h[n] for n in Tree._fields]) for h in held])


def _packed(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@dataclass(frozen=True)
class _Plan:
    """What every task knows: bins of each feature, which are categories, classes and settings."""

    widths: tuple[int, ...]
    category: np.ndarray
    classes: int
    chosen: int
    trees: Trees

    @property
    def kind(self):
        return np.uint8 if max(*self.widths, self.classes) <= 256 else np.uint16

    @property
    def step(self) -> int:
        """Numbers of a record: the bins, the class, the weight and what fills it up to 8 bytes."""
        size = np.dtype(self.kind).itemsize
        return -(-(len(self.widths) + 2) * size // 8) * 8 // size


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salt(plan: _Plan, tree: int, use: int) -> np.uint64:
    return _mix(np.array([(plan.trees.seed * 1_000_003 + tree * 2 + use + 1) & (2**64 - 1)], dtype=np.uint64))[0]


def _weights(plan: _Plan, draw: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree drew each row."""
    return _POISSON[(_mix(draw ^ _salt(plan, tree, 0)) >> np.uint64(48)).astype(np.int64)]


def _choice(plan: _Plan, tree: int, nodes: np.ndarray) -> np.ndarray:
    """Which features each node may split."""
    n = len(plan.widths)
    if plan.chosen >= n:
        return np.ones((len(nodes), n), dtype=bool)
    code = nodes.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64)[None, :]
    order = np.argsort(_mix(code ^ _salt(plan, tree, 1)), axis=1)
    chosen = np.zeros((len(nodes), n), dtype=bool)
    np.put_along_axis(chosen, order[:, : plan.chosen], True, axis=1)
    return chosen


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers of the ranges ``[first, first + count)`` one after another."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _worth(part: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.einsum("...c,...c->...", part, part) / np.maximum(total, 1)


def _subsets(codes: int) -> np.ndarray:
    """All ways to send some codes left, the last one going right."""
    return (np.arange(1, 1 << (codes - 1))[:, None] >> np.arange(codes)[None, :]) & 1


def _all_subsets(plan: _Plan, f: int) -> bool:
    return bool(plan.category[f]) and 2 <= plan.widths[f] <= SHORT


def _gains(plan: _Plan, left: np.ndarray, whole: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What splits with these weights on their left sides save of ``whole`` of their nodes."""
    size = whole.sum(axis=-1)
    held = left.sum(axis=-1)
    rest = size[owner] - held
    gain = _worth(left, held) + _worth(whole[owner] - left, rest) - _worth(whole, size)[owner]
    least = max(plan.trees.min_rows, 1)
    gain[(held < least) | (rest < least)] = -np.inf
    return gain


def _best_subset(plan: _Plan, f: int, sums: np.ndarray, whole: np.ndarray):
    """Gain, cut and left codes of the best split of a short category in each node, by all its bins."""
    subsets = _subsets(plan.widths[f])
    n, width, classes = sums.shape
    left = (subsets.astype(np.float64) @ sums.transpose(1, 0, 2).reshape(width, n * classes)).reshape(-1, n, classes)
    gain = _gains(plan, left, whole, np.arange(n))
    cut = gain.argmax(axis=0)
    return gain[cut, np.arange(n)], cut.astype(np.int32), subsets[cut].astype(bool)


def _best_cut(plan: _Plan, f: int, cells: np.ndarray, sums: np.ndarray, whole: np.ndarray):
    """Gain, cut and left codes (categories only) of the best split of ``f`` in each node.

    ``cells`` are the bins that hold rows (node * width + bin, in order), at least one a node, ``sums``
    their classes. Between two of them every cut is the same, and the first is taken, so
    empty bins need no place here.
    """
    n, width = len(whole), plan.widths[f]
    owner, code = np.divmod(cells, width)
    first = np.searchsorted(owner, np.arange(n))
    if plan.category[f]:
        total = sums.sum(axis=1)
        order = np.lexsort((np.where(total > 0, 1 - _worth(sums, total) / np.maximum(total, 1), np.inf), owner))
        code, sums = code[order], sums[order]
    left = np.cumsum(sums, axis=0)
    left[first[1] if n > 1 else len(left) :] -= np.repeat(left[first[1:] - 1], np.diff(np.append(first[1:], len(owner))), axis=0)
    gain = _gains(plan, left, whole, owner)
    best = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == best[owner])
    at = at[np.searchsorted(owner[at], np.arange(n))]
    masks = np.zeros((n, width), dtype=bool)
    if not plan.category[f]:
        return best, code[at].astype(np.int32), masks
    goes = np.arange(len(owner)) <= at[owner]
    masks[owner[goes], code[goes]] = True
    return best, (at - first).astype(np.int32), masks


class _Splits:
    """The best split found so far of each of some nodes."""

    def __init__(self, plan: _Plan, n: int):
        self.gain = np.full(n, -np.inf)
        self.feature = np.full(n, -1, dtype=np.int16)
        self.cut = np.zeros(n, dtype=np.int32)
        self.masks = np.zeros((n, -(-max(plan.widths) // 8)), dtype=np.uint8)

    def offer(self, plan: _Plan, f: int, nodes: np.ndarray, found: tuple[np.ndarray, ...], whole: np.ndarray) -> None:
        """Take what was ``found`` (gain, cut, left codes) for ``f`` in ``nodes`` where it is better."""
        gain, cut, masks = found
        better = (gain > self.gain[nodes]) & (gain > 1e-12 * np.maximum(1.0, whole[nodes]))
        to = nodes[better]
        self.gain[to], self.feature[to], self.cut[to] = gain[better], f, cut[better]
        if plan.category[f]:
            bits = np.packbits(masks[better], axis=1, bitorder="little")
            self.masks[to] = 0
            self.masks[to, : bits.shape[1]] = bits


def _right(category: np.ndarray, x, rows, at, feature, cut, masks, mask_at) -> np.ndarray:
    """Whether rows of ``x`` go right at their (inner) nodes."""
    f = feature[at]
    value = x.reshape(-1).take(rows * x.shape[1] + f).astype(np.int64)
    right = value > cut[at]
    coded = np.flatnonzero(category[f])
    if len(coded):
        v = value[coded]
        right[coded] = (masks[mask_at[at[coded]], v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 0
    return right


def _turns(count: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of nodes with about as many rows as stay in a core's cache; a node of more rows is alone."""
    if not len(count):
        return []
    large = count > TURN
    turn = np.cumsum(np.where(large, 0, count)) // TURN
    ends = np.flatnonzero((np.diff(turn) > 0) | large[1:] | large[:-1]) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(count)], strict=True))


def _open(plan: _Plan, level: int, whole: np.ndarray) -> np.ndarray:
    """Which nodes of a level may be split, by the weights of their classes."""
    return (whole.sum(axis=1) >= 2 * plan.trees.min_rows) & ((whole > 0).sum(axis=1) > 1) & (level < plan.trees.depth)


def _records(plan: _Plan, x: Sequence[np.ndarray], y: np.ndarray, w: np.ndarray | int) -> np.ndarray:
    """Records of rows from their bins (by feature), classes and weights."""
    rows = np.zeros((len(y), plan.step), dtype=plan.kind)
    for i, column in enumerate((*x, y, w)):
        rows[:, i] = column
    return rows


def _take(rows: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Some records, moved as whole numbers of 8 bytes."""
    if out is not None:
        np.take(rows.view(np.uint64), at, axis=0, out=out.view(np.uint64), mode="clip")
        return out
    return rows.view(np.uint64).take(at, axis=0).view(rows.dtype)


def _node_sums(plan: _Plan, rows: np.ndarray, chosen: np.ndarray):
    """Cells and class sums of every chosen feature of one node, turn by turn."""
    n = len(plan.widths)
    sums = {int(f): np.zeros(plan.widths[f] * plan.classes) for f in np.flatnonzero(chosen[0])}
    for i in range(0, len(rows), TURN):
        part = rows[i : i + TURN]
        y, w = part[:, n].astype(np.int64), part[:, n + 1].astype(np.float64)
        for f, total in sums.items():
            cell = part[:, f].astype(np.int64)
            cell *= plan.classes
            cell += y
            total += np.bincount(cell, weights=w, minlength=len(total))
    return {f: (np.arange(plan.widths[f]), total.reshape(-1, plan.classes)) for f, total in sums.items()}


def _turn_sums(plan: _Plan, rows: np.ndarray, count: np.ndarray, chosen: np.ndarray):
    """Cells (as in ``_best_cut``) and class sums of every feature in the nodes that may split it.

    All nodes may split equally many features, so the rows are gone through once for the first of
    these features of each node, once for the second and so on. A feature with too many bins for its rows
    gets only those that hold rows.
    """
    n, m = len(plan.widths), len(count)
    nodes = [np.flatnonzero(chosen[:, f]) for f in range(n)]
    full = [_all_subsets(plan, f) or len(nodes[f]) * plan.widths[f] * DENSE <= int(count[nodes[f]].sum()) for f in range(n)]
    nth = np.cumsum(chosen, axis=1) - 1
    feature = np.nonzero(chosen)[1].reshape(m, -1)
    first, places, end = np.zeros_like(feature), {}, 0
    for f in sorted(range(n), key=lambda f: not full[f]):
        if len(nodes[f]):
            first[nodes[f], nth[nodes[f], f]] = end + np.arange(len(nodes[f])) * plan.widths[f]
            places[f] = (end, end + len(nodes[f]) * plan.widths[f])
            end = places[f][1]
    dense = max([0, *(places[f][1] for f in places if full[f])])
    flat, start = rows.reshape(-1), np.arange(len(rows)) * plan.step
    y, w = rows[:, n].astype(np.int64), rows[:, n + 1].astype(np.float64)
    cells = []
    for k in range(feature.shape[1]):
        cell = flat.take(start + np.repeat(feature[:, k], count)).astype(np.int64)
        cell += np.repeat(first[:, k], count)
        cells.append(cell)
    rank = None
    if dense < end:
        held = np.zeros(end, dtype=bool)
        held[:dense] = True
        for cell in cells:
            held[cell] = True
        rank = np.cumsum(held) - 1
    size = (end if rank is None else int(rank[-1]) + 1) * plan.classes
    sums = np.zeros(size)
    for cell in cells:
        cell = cell if rank is None else rank.take(cell)
        cell *= plan.classes
        cell += y
        sums += np.bincount(cell, weights=w, minlength=size)
    sums = sums.reshape(-1, plan.classes)
    out = {}
    for f, (low, high) in places.items():
        if full[f]:
            out[f] = (np.arange(high - low), sums[low:high])
        else:
            at = np.flatnonzero(held[low:high])
            out[f] = (at, sums[rank[low + at[0]] : rank[low + at[0]] + len(at)])
    return out


def _goes_right(plan: _Plan, found: _Splits, nodes: np.ndarray) -> np.ndarray:
    """For each bin of the split feature of some nodes whether its rows go right."""
    widest = max(plan.widths)
    right = np.arange(widest)[None, :] > found.cut[nodes][:, None]
    coded = np.flatnonzero(plan.category[found.feature[nodes]])
    right[coded] = np.unpackbits(found.masks[nodes[coded]], axis=1, bitorder="little")[:, :widest] == 0
    return right


def _grow(plan: _Plan, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """The subtree of ``root`` from the bins (by feature), classes and weights of its rows."""
    return _grow_records(plan, tree, root, _records(plan, x, y, w))


def _grow_records(plan: _Plan, tree: int, root: int, rows: np.ndarray):
    """The subtree of ``root`` from the records of its rows: parts of nodes in the order of their ids, and what each feature saved.

    The records of a node lie next to each other; those of its children take the same place in a second
    array, and so on in turn. The nodes of a turn are grown to the bottom before the next turn.
    """
    n, classes, widest = len(plan.widths), plan.classes, max(plan.widths)
    saved, out = np.zeros(n), []
    no_masks = np.zeros((0, -(-widest // 8)), dtype=np.uint8)

    def leaves(heap, whole):
        out.append((heap, np.full(len(heap), -1, dtype=np.int16), np.zeros(len(heap), dtype=np.int32), no_masks, whole))

    level = (root + 1).bit_length() - 1
    heap, whole = np.array([root], dtype=np.int64), np.zeros((1, classes))
    for i in range(0, len(rows), TURN):
        whole[0] += np.bincount(rows[i : i + TURN, n], weights=rows[i : i + TURN, n + 1], minlength=classes)
    todo = []
    if _open(plan, level, whole)[0]:
        todo.append((level, heap, np.array([len(rows)]), whole, 0, 0))
    else:
        leaves(heap, whole)
    both = (rows, np.empty_like(rows) if todo else rows)
    while todo:
        level, heap, count, whole, side, low = todo.pop()
        m, total = len(heap), int(count.sum())
        own, other = both[side][low : low + total], both[1 - side][low : low + total]
        chosen = _choice(plan, tree, heap)
        found, size = _Splits(plan, m), whole.sum(axis=1)
        alone = m == 1 and total > TURN
        for f, (cells, sums) in sorted((_node_sums(plan, own, chosen) if alone else _turn_sums(plan, own, count, chosen)).items()):
            part = np.flatnonzero(chosen[:, f])
            best = _best_subset(plan, f, sums.reshape(len(part), -1, classes), whole[part]) if _all_subsets(plan, f) else _best_cut(plan, f, cells, sums, whole[part])
            found.offer(plan, f, part, best, size)
        inner = found.feature >= 0
        np.add.at(saved, found.feature[inner], found.gain[inner])
        out.append((heap, found.feature, found.cut, found.masks[inner & plan.category[found.feature]], whole[~inner]))
        if not inner.any():
            continue
        goes = _goes_right(plan, found, np.arange(m))
        heap = (2 * heap[inner][:, None] + np.array([1, 2])[None, :]).ravel()
        if alone:
            count, whole = _halved(plan, own, other, int(found.feature[0]), goes[0], level + 1)
            keep = _open(plan, level + 1, whole)
            if not keep[0]:
                low += int(count[0])
        else:
            # rows of leaves go behind all others
            child = np.where(inner, 2 * (np.cumsum(inner) - 1), 2 * int(inner.sum()))
            value = own.reshape(-1).take(np.arange(total) * plan.step + np.repeat(np.maximum(found.feature, 0).astype(np.int64), count)).astype(np.int64)
            value += np.repeat(np.arange(m) * widest, count)
            goes[~inner] = False
            to = np.repeat(child, count)
            to += goes.reshape(-1).take(value)
            many = len(heap)
            whole = np.bincount(to * classes + own[:, n], weights=own[:, n + 1], minlength=(many + 1) * classes).reshape(-1, classes)[:many]
            keep = _open(plan, level + 1, whole)
            if keep.any():
                kept = int(keep.sum())
                if kept < many:
                    to = np.append(np.where(keep, np.cumsum(keep) - 1, kept), kept).take(to)
                count = np.bincount(to, minlength=kept)[:kept]
                # short numbers are sorted by counting
                order = np.argsort(to.astype(np.uint16) if many < 1 << 16 else to, kind="stable")[: int(count.sum())]
                _take(own, order, other[: len(order)])
        if not keep.all():
            leaves(heap[~keep], whole[~keep])
        heap, whole = heap[keep], whole[keep]
        count = count[keep] if alone else count
        if not keep.any():
            continue
        ends = np.cumsum(count)
        for i, j in _turns(count):
            todo.append((level + 1, heap[i:j], count[i:j], whole[i:j], 1 - side, low + int(ends[i] - count[i])))
    ids, feature, cut, masks, counts = (np.concatenate(c) for c in zip(*out, strict=True))
    return (*_pruned(plan, ids, feature, cut, masks, counts), saved)


def _halved(plan: _Plan, own: np.ndarray, other: np.ndarray, f: int, goes: np.ndarray, level: int):
    """Rows and class weights of the two children of a large node; its rows are dealt to both ends of ``other``."""
    n = len(plan.widths)
    left, right, whole = 0, len(own), np.zeros((2, plan.classes))
    for i in range(0, len(own), TURN):
        part = own[i : i + TURN]
        to = goes.take(part[:, f])
        whole += np.bincount(to * np.int64(plan.classes) + part[:, n], weights=part[:, n + 1], minlength=2 * plan.classes).reshape(2, -1)
        if level < plan.trees.depth:
            second = np.flatnonzero(to)
            first = np.flatnonzero(~to)
            _take(part, first, other[left : left + len(first)])
            _take(part, second, other[right - len(second) : right])
            left, right = left + len(first), right - len(second)
    return np.array([left, len(own) - left]), whole


def _pruned(plan: _Plan, ids, feature, cut, masks, counts):
    """Siblings that are leaves and predict the same class become one leaf; nodes come in the order of their ids."""
    order = np.argsort(ids, kind="stable")
    mask_of, count_of = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), -1, dtype=np.int64)
    mask_of[(feature >= 0) & plan.category[feature]] = np.arange(len(masks))
    count_of[feature < 0] = np.arange(len(counts))
    ids, feature, cut, mask_of, count_of = ids[order], feature[order].copy(), cut[order], mask_of[order], count_of[order]
    held = np.zeros((len(ids), plan.classes))
    held[count_of >= 0] = counts[count_of[count_of >= 0]]
    gone = np.zeros(len(ids), dtype=bool)
    for level in range(plan.trees.depth - 1, -1, -1):
        low, high = np.searchsorted(ids, [(1 << level) - 1, (1 << (level + 1)) - 1])
        inner = low + np.flatnonzero(feature[low:high] >= 0)
        child = np.searchsorted(ids, 2 * ids[inner] + 1)
        # a child may not be grown yet
        there = (child + 1 < len(ids)) & (ids[np.minimum(child, len(ids) - 1)] == 2 * ids[inner] + 1)
        inner, child = inner[there], child[there]
        same = (feature[child] < 0) & (feature[child + 1] < 0) & (held[child].argmax(axis=1) == held[child + 1].argmax(axis=1))
        inner, child = inner[same], child[same]
        feature[inner], held[inner] = -1, held[child] + held[child + 1]
        gone[child] = gone[child + 1] = True
    keep = ~gone
    inner = keep & (feature >= 0) & (mask_of >= 0)
    return ids[keep], feature[keep], cut[keep], masks[mask_of[inner]], held[keep & (feature < 0)]


def _tree(plan: _Plan, ids, feature, cut, masks, counts) -> Tree:
    left = np.zeros(len(ids), dtype=np.int32)
    inner = feature >= 0
    left[inner] = np.searchsorted(ids, 2 * ids[inner] + 1)
    left[~inner] = np.arange(len(counts))
    coded = inner & plan.category[feature]
    cut = cut.copy()
    cut[coded] = np.arange(len(masks))
    return Tree(feature.astype(np.int16), cut.astype(np.int32), left, masks, counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))


class _Top:
    """The nodes of a tree that were split by histograms: splits, and where rows go on."""

    def __init__(self, plan: _Plan):
        self.feature, self.cut, self.mask_at = np.full(1, -1, dtype=np.int16), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.masks = np.zeros((1, -(-max(plan.widths) // 8)), dtype=np.uint8)
        self.local, self.sizes, self.leaves = [], [], {}

    def split(self, node: int, feature: int, cut: int, mask: np.ndarray) -> None:
        if 2 * node + 3 > len(self.feature):
            more = 2 * len(self.feature) + 1 - len(self.feature)
            self.feature = np.concatenate([self.feature, np.full(more, -1, dtype=np.int16)])
            self.cut = np.concatenate([self.cut, np.zeros(more, dtype=np.int32)])
            self.mask_at = np.concatenate([self.mask_at, np.zeros(more, dtype=np.int64)])
        self.feature[node], self.cut[node], self.mask_at[node] = feature, cut, len(self.masks)
        self.masks = np.concatenate([self.masks, mask[None, :]])

    def route(self, plan: _Plan, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        while True:
            go = np.flatnonzero(self.feature[at] >= 0)
            if not len(go):
                return at
            at[go] = 2 * at[go] + 1 + _right(plan.category, x, rows[go], at[go], self.feature, self.cut, self.masks, self.mask_at)


def _blocks(plan: _Plan, batches):
    """Records and draws of the blocks of a stored table."""
    for b in batches:
        for rows, draw in zip(b.column(0), b.column(1), strict=True):
            yield np.frombuffer(rows.as_buffer(), dtype=plan.kind).reshape(-1, plan.step), np.frombuffer(draw.as_buffer(), dtype=np.uint64)


def _sum_top(plan: _Plan, sent):
    """Histograms of the open nodes, one row a tree: their chosen features one after another."""

    def add(batches):
        tops, opened = sent.value
        chosen = {t: _choice(plan, t, nodes) for t, nodes in opened.items()}
        sums = {t: [np.zeros((int(c[:, f].sum()), plan.widths[f], plan.classes)) for f in range(len(plan.widths))] for t, c in chosen.items()}
        for x, draw in _blocks(plan, batches):
            y = x[:, len(plan.widths)].astype(np.int64)
            for t, nodes in opened.items():
                w = _weights(plan, draw, t)
                rows = np.flatnonzero(w)
                at = tops[t].route(plan, x, rows)
                place = np.searchsorted(nodes, at)
                hit = np.flatnonzero(nodes[np.minimum(place, len(nodes) - 1)] == at)
                count = np.bincount(place[hit], minlength=len(nodes))
                first = np.cumsum(count) - count
                rows = rows[hit[np.argsort(place[hit], kind="stable")]] if len(nodes) > 1 else rows[hit]
                classes, weights = y[rows], w[rows].astype(np.float64)
                for f in range(len(plan.widths)):
                    some = np.flatnonzero(chosen[t][:, f])
                    if len(some):
                        use = _ranges(first[some], count[some])
                        cell = np.repeat(np.arange(len(some)), count[some]) * plan.widths[f] + x[rows[use], f]
                        size = len(some) * plan.widths[f] * plan.classes
                        sums[t][f] += np.bincount(cell * plan.classes + classes[use], weights=weights[use], minlength=size).reshape(sums[t][f].shape)
        held = [np.concatenate([s.ravel() for s in of]).astype(np.int64).tobytes() for of in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(held, pa.binary())], names=["tree", "sums"])

    return add


_SPLIT_NAMES = ["tree", "node", "feature", "cut", "gain", "mask", "whole", "left"]
_SPLITS = "tree int, node long, feature int, cut int, gain double, mask binary, whole binary, left binary"
_SPLIT_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]


def _best_top(plan: _Plan, sent):
    def best(key, table):
        tree = key[0].as_py()
        nodes = sent.value[1][tree]
        chosen = _choice(plan, tree, nodes)
        flat = sum(np.frombuffer(s.as_buffer(), dtype=np.int64) for s in table.column("sums")).astype(np.float64)
        found, whole, sums, first = _Splits(plan, len(nodes)), np.zeros((len(nodes), plan.classes)), [], 0
        for f in range(len(plan.widths)):
            at = np.flatnonzero(chosen[:, f])
            size = len(at) * plan.widths[f] * plan.classes
            sums.append(flat[first : first + size].reshape(len(at), plan.widths[f], plan.classes))
            whole[at] = sums[f].sum(axis=1)
            first += size
        for f in range(len(plan.widths)):
            part = np.flatnonzero(chosen[:, f])
            if not len(part):
                continue
            if _all_subsets(plan, f):
                found.offer(plan, f, part, _best_subset(plan, f, sums[f], whole[part]), whole.sum(axis=1))
            else:
                cells = np.arange(len(part) * plan.widths[f])
                found.offer(plan, f, part, _best_cut(plan, f, cells, sums[f].reshape(-1, plan.classes), whole[part]), whole.sum(axis=1))
        left = np.zeros_like(whole)
        for i, f in enumerate(found.feature):
            if f >= 0:
                bins = sums[f][int(chosen[:i, f].sum())]
                goes = np.unpackbits(found.masks[i], bitorder="little")[: len(bins)] if plan.category[f] else np.arange(len(bins)) <= found.cut[i]
                left[i] = bins[goes.astype(bool)].sum(axis=0)
        columns = [[tree] * len(nodes), nodes, found.feature.astype(np.int32), found.cut, found.gain, [m.tobytes() for m in found.masks], [c.tobytes() for c in whole], [c.tobytes() for c in left]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SPLIT_TYPES, strict=True)], names=_SPLIT_NAMES)

    return best


def _drawn(plan: _Plan, top: _Top, tree: int, roots: np.ndarray, rows: np.ndarray, draw: np.ndarray):
    """The records of a block that a tree drew into each of some of its nodes, with their weights."""
    w = _weights(plan, draw, tree)
    drawn = np.flatnonzero(w)
    if len(top.feature) > 1:
        at = top.route(plan, rows, drawn)
        place = np.searchsorted(roots, at)
        hit = np.flatnonzero(roots[np.minimum(place, len(roots) - 1)] == at)
        order = hit[np.argsort(at[hit], kind="stable")]
        there, first = np.unique(at[order], return_index=True)
        parts = [drawn[p] for p in np.split(order, first[1:])] if len(there) else []
    else:
        there, parts = roots, [drawn]
    for root, part in zip(there.tolist(), parts, strict=True):
        found = _take(rows, part)
        found[:, len(plan.widths) + 1] = w[part]
        yield root, found


def _deal(plan: _Plan, sent):
    """The rows of every node whose subtree is still to be grown: one row a block, tree and node."""

    def rows(batches):
        for x, draw in _blocks(plan, batches):
            for t, top in sent.value.items():
                found = list(_drawn(plan, top, t, top.local, x, draw))
                columns = [pa.array([t] * len(found), pa.int32()), pa.array([r for r, _ in found], pa.int64()), pa.array([p.tobytes() for _, p in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "root", "rows"])

    return rows


_NODE_NAMES = ["tree", "ids", "feature", "cut", "masks", "counts", "gain"]
_NODES = "tree int, " + ", ".join(f"{n} binary" for n in _NODE_NAMES[1:])
_NODE_TYPES = (np.int64, np.int16, np.int32, np.uint8, np.uint32, np.float64)


def _grown(plan: _Plan, tree: int, root: int, rows: np.ndarray) -> list[list]:
    """A row of ``_NODES``, column by column."""
    parts = _grow_records(plan, tree, root, rows)
    return [[tree], *[[np.ascontiguousarray(p.astype(k)).tobytes()] for p, k in zip(parts, _NODE_TYPES, strict=True)]]


def _grow_dealt(plan: _Plan):
    def grow(key, table):
        rows = np.concatenate([np.frombuffer(s.as_buffer(), dtype=plan.kind) for s in table.column("rows")]).reshape(-1, plan.step)
        columns = _grown(plan, key[0].as_py(), key[1].as_py(), rows)
        return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_NODE_NAMES)

    return grow


def _grow_read(plan: _Plan, sent):
    """Every subtree of a job, from all blocks of the table."""

    def grow(batches):
        tops, jobs = sent.value
        held: dict[tuple[int, int], list] = {}
        job = None

        def grown():
            for t, root in list(held):
                columns = _grown(plan, t, root, np.concatenate(held.pop((t, root))))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_NODE_NAMES)

        for b in batches:
            for of, (rows, draw) in zip(b.column(2).to_pylist(), _blocks(plan, [b]), strict=True):
                if of != job:
                    yield from grown()
                    job = of
                for t, roots in jobs[job].items():
                    for root, part in _drawn(plan, tops[t], t, roots, rows, draw):
                        held.setdefault((t, root), []).append(part)
        yield from grown()

    return grow


def _jobs(tops: dict[int, _Top], cores: int) -> list[dict[int, np.ndarray]]:
    """Nodes to be grown, by tree, dealt to jobs of at most ``LOCAL_ROWS`` rows, a few jobs for each core."""
    roots = [(t, int(node), size) for t, top in tops.items() for node, size in zip(top.local, top.sizes, strict=True)]
    total = sum(r[2] for r in roots)
    most = min(LOCAL_ROWS, total / (cores if total < 1 << 22 else 4 * cores))
    jobs, held = [], 0
    for t, node, size in roots:
        if not jobs or held + size > most:
            jobs.append({})
            held = 0
        jobs[-1].setdefault(t, []).append(node)
        held += size
    return [{t: np.sort(np.array(nodes, dtype=np.int64)) for t, nodes in job.items()} for job in jobs]


def _inputs(features: Sequence[str], categories: dict[str, list[str]]) -> list[Column]:
    """What tasks need of each feature: the text of a category, the value of a number."""
    return [(F.col(f).cast("string") if f in categories else _value(f, categories)).alias(f"x{i}") for i, f in enumerate(features)]


def _bins(features: Sequence[str], categories: dict[str, list[str]], edges: list[np.ndarray], columns: Sequence[pa.Array]) -> list[np.ndarray]:
    """The bin of every row in each feature; values that a category does not know come behind all it knows."""
    out = []
    for f, e, column in zip(features, edges, columns, strict=True):
        if f in categories:
            known = pa.array(categories[f], pa.string())
            out.append(pc.index_in(column.cast(pa.string()), value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False))
        else:
            out.append(np.searchsorted(e, column.to_numpy(zero_copy_only=False), side="left"))
    return out


def _bin_rows(plan: _Plan, features: Sequence[str], categories: dict[str, list[str]], edges: list[np.ndarray]):
    """Blocks of records and draws from classes, draws and the inputs of the features."""

    def rows(batches):
        held, draws, n = [], [], 0

        def block():
            columns = [np.concatenate(held).tobytes(), np.concatenate(draws).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["rows", "draws"])

        for b in batches:
            if b.num_rows:
                held.append(_records(plan, _bins(features, categories, edges, b.columns[2:]), b.column(0).to_numpy(), 0))
                draws.append(b.column(1).to_numpy())
                n += b.num_rows
            if n >= BLOCK:
                yield block()
                held, draws, n = [], [], 0
        if n:
            yield block()

    return rows


def _apart(df: DataFrame) -> list:
    """Rows of a union whose sides have a partition each; Spark would make one task of them all."""
    conf, setting = df.sparkSession.conf, "spark.sql.unionOutputPartitioning"
    before = conf.get(setting, None)
    conf.set(setting, "false")
    try:
        return df.collect()
    finally:
        conf.unset(setting) if before is None else conf.set(setting, before)


def fit(
    train: DataFrame, label: str, labels: Sequence[str], categories: Sequence[str] = (), known: Sequence[Sequence[str]] = (), numbers: Sequence[str] = (),
    trees: Trees = Trees(100, 15, min_rows=5), bins: int = 64, draw: str = "draw", local_rows: int | None = None,
) -> Forest:
    """Fit a forest of the classes ``labels`` of a stored frame; rows of other classes are left out.

    ``known`` are the values of each category, ``draw`` a long column, different in every row, from
    which the trees draw; a node of at most ``local_rows`` drawn rows is grown by one task.
    """
    spark = train.sparkSession
    features = (*categories, *numbers)
    named = {c: list(v) for c, v in zip(categories, known, strict=True)}
    y = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label).cast("string")) - 1
    rows = train.withColumn("_y", y.cast("int")).where("_y >= 0")
    values = [_value(f, named) for f in features]
    points = [i / bins for i in range(1, bins)]
    asked = [F.percentile_approx(v, points, 10000).alias(f"q{i}") for i, v in enumerate(values) if features[i] not in named]
    n, *quantiles = rows.agg(F.count("*").alias("n"), *asked).first()
    if not n:
        raise ValueError("a forest needs training rows")
    edges = [_edges(named[f], None) for f in categories] + [_edges(None, q) for q in quantiles]
    few = len(features) if trees.rounds == 1 else ceil(sqrt(len(features)))
    plan = _Plan(tuple(len(x) + 1 for x in edges), np.array([f in named for f in features]), len(labels), few, trees)
    reads = n <= READS * LOCAL_ROWS
    local_rows = local_rows or (LOCAL_ROWS if reads else DEALT_ROWS)
    coded = rows.select("_y", F.col(draw).alias("draw"), *_inputs(features, named))
    table = bounded_batches(workdir.materialise(coded.mapInArrow(_bin_rows(plan, features, named, edges), "rows binary, draws binary"), "forest"))

    tops = {t: _Top(plan) for t in range(trees.rounds)}
    opened = {}
    for t, top in tops.items():
        if n > local_rows and trees.depth > 0:
            opened[t] = np.zeros(1, dtype=np.int64)
        else:
            top.local, top.sizes = [0], [n]
    saved = np.zeros((trees.rounds, len(features)))
    while opened:
        sent = spark.sparkContext.broadcast((tops, opened))
        split = table.mapInArrow(_sum_top(plan, sent), "tree int, sums binary").groupBy("tree").applyInArrow(_best_top(plan, sent), _SPLITS).collect()
        opened = {}
        for r in sorted(split, key=lambda r: (r["tree"], r["node"])):
            top, node, whole = tops[r["tree"]], r["node"], np.frombuffer(r["whole"])
            if r["feature"] < 0 or (whole > 0).sum() < 2:
                top.leaves[node] = whole
                continue
            top.split(node, r["feature"], r["cut"], np.frombuffer(r["mask"], dtype=np.uint8))
            saved[r["tree"], r["feature"]] += r["gain"]
            deepest = (2 * node + 2).bit_length() - 1 >= trees.depth
            left = np.frombuffer(r["left"])
            for child, held in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                if deepest or (held > 0).sum() < 2:
                    top.leaves[child] = held
                elif held.sum() <= local_rows:
                    top.local.append(child)
                    top.sizes.append(held.sum())
                else:
                    opened.setdefault(r["tree"], []).append(child)
        opened = {t: np.sort(np.array(v, dtype=np.int64)) for t, v in opened.items()}
    if reads:
        jobs = _jobs(tops, spark.sparkContext.defaultParallelism)
        sent = spark.sparkContext.broadcast(({t: top for t, top in tops.items() if top.local}, jobs))
        # a task a job, which reads the whole table
        whole = [table.coalesce(1).withColumn("job", F.lit(i)) for i in range(len(jobs))]
        subtrees = _apart(reduce(DataFrame.unionAll, whole).mapInArrow(_grow_read(plan, sent), _NODES)) if jobs else []
    else:
        for top in tops.values():
            top.local = np.sort(np.array(top.local, dtype=np.int64))
        sent = spark.sparkContext.broadcast({t: top for t, top in tops.items() if len(top.local)})
        groups = sum(len(top.local) for top in tops.values())
        # more partitions than groups leave few partitions with several of them
        deal = max(1, min(2 * groups, max(32 * spark.sparkContext.defaultParallelism, n * trees.rounds // local_rows)))
        dealt = table.mapInArrow(_deal(plan, sent), "tree int, root long, rows binary").repartition(deal, "tree", "root")
        subtrees = dealt.groupBy("tree", "root").applyInArrow(_grow_dealt(plan), _NODES).collect()
    grown: dict[int, list] = {t: [] for t in tops}
    for r in subtrees:
        parts = [np.frombuffer(r[c], dtype=k) for c, k in zip(_NODE_NAMES[1:], _NODE_TYPES, strict=True)]
        parts[3], parts[4] = parts[3].reshape(-1, -(-max(plan.widths) // 8)), parts[4].reshape(-1, plan.classes)
        saved[r["tree"]] += parts[5]
        grown[r["tree"]].append(parts[:5])
    model = Forest(tuple(features), named, edges, tuple(labels), np.zeros(len(features)), [_whole(plan, tops[t], grown.pop(t)) for t in sorted(tops)])
    total = saved.sum(axis=1, keepdims=True)
    model.gain = np.divide(saved, total, out=np.zeros_like(saved), where=total > 0).mean(axis=0)
    return model


def _whole(plan: _Plan, top: _Top, parts: list) -> Tree:
    """A tree from its upper nodes and its subtrees; a tree that drew nothing is one leaf without weight."""
    ids = np.flatnonzero(top.feature >= 0)
    feature = top.feature[ids]
    parts = [(ids, feature, top.cut[ids], top.masks[top.mask_at[ids[plan.category[feature]]]], np.zeros((0, plan.classes))), *parts]
    if top.leaves:
        at = np.array(sorted(top.leaves), dtype=np.int64)
        parts.append((at, np.full(len(at), -1, dtype=np.int16), np.zeros(len(at), dtype=np.int32), np.zeros((0, top.masks.shape[1]), dtype=np.uint8), np.stack([top.leaves[i] for i in at])))
    joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
    if not len(joined[0]):
        joined = [np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int16), np.zeros(1, dtype=np.int32), joined[3], np.zeros((1, plan.classes))]
    return _tree(plan, *_pruned(plan, *joined))


class _Steps(NamedTuple):
    """How rows go down a tree: the split feature of each node, where its row of ``right`` begins (a place
    a bin, whether it goes right) and the left child; a leaf leads to itself."""

    feature: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _steps(tree: Tree, widths: Sequence[int], category: np.ndarray) -> _Steps:
    feature, first, left, parts, end = tree.feature.astype(np.int64), np.zeros(len(tree.feature), dtype=np.int64), tree.left.astype(np.int64), [], 0
    for f, width in enumerate(widths):
        at = np.flatnonzero(tree.feature == f)
        first[at] = end + np.arange(len(at)) * width
        end += len(at) * width
        cut = tree.cut[at]
        right = np.unpackbits(tree.masks[cut], axis=1, bitorder="little")[:, :width] == 0 if category[f] else np.arange(width)[None, :] > cut[:, None]
        parts.append(right.ravel())
    leaf = np.flatnonzero(tree.feature < 0)
    feature[leaf], first[leaf], left[leaf] = 0, end, leaf
    return _Steps(feature, first, left, np.concatenate([*parts, np.zeros(max(widths), dtype=bool)]))


def _votes(model: Forest, steps: list[_Steps], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the class shares in each row's leaf."""
    n = len(x)
    total, flat, start = np.zeros((n, len(model.outputs))), x.reshape(-1), np.arange(n) * x.shape[1]
    for tree, step in zip(model.trees, steps, strict=True):
        at, before = np.zeros(n, dtype=np.int64), None
        while before is None or not np.array_equal(at, before):
            before = at
            bins = flat.take(start + step.feature.take(at))
            at = step.left.take(at) + step.right.take(step.first.take(at) + bins)
        held = tree.counts[tree.left[at]].astype(np.float64)
        total += held / np.maximum(held.sum(axis=1, keepdims=True), 1)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)


def predict(model: Forest, df: DataFrame, name: str = "probability") -> DataFrame:
    """``df`` with ``name``: the class probabilities in the order of ``model.outputs``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        widths = [len(e) + 1 for e in m.edges]
        steps = None
        for s in batches:
            if steps is None:
                category = np.array([f in m.categories for f in m.features])
                steps = [_steps(tree, widths, category) for tree in m.trees]
            x = np.column_stack(_bins(m.features, m.categories, m.edges, s.flatten())).astype(np.min_scalar_type(max(widths)))
            votes = _votes(m, steps, x)
            yield pa.ListArray.from_arrays(np.arange(0, votes.size + 1, votes.shape[1], dtype=np.int32), pa.array(votes.ravel()))

    return df.withColumn(name, shares(F.struct(*_inputs(model.features, model.categories))))
