"""Best-fit packing through a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits into one sequence. The program covers the
count of every length with as few configurations as possible. It is solved by multiplicative
weights: lengths that are covered already lose weight, and a knapsack dynamic program finds the
configurations of (nearly) greatest weight. The fractional counts are rounded along their running
sum, and what rounding leaves uncovered is packed best-fit. All of that sees the histogram only,
at most ``capacity`` numbers, so it runs on the driver at any size of corpus; pieces then find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.bpe import load, slices
from spindrift.llm.common import offsets, returning_memory, stored

#: Share of a length's demand that one round of the solver may cover.
STEP = 0.5
#: Loss of weight of a length once its whole demand is covered: a factor of exp(-DECAY).
DECAY = 0.2
ROUNDS = 600
#: Weights start as this power of the length: long pieces, which are hard to place, come first.
CONVEX = 1.3
#: Configurations within this share of the best are used together.
NEAR = 0.01
#: Pieces of one length that are ranked together.
RANKED = 1 << 11


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value within each capacity, and the index of a length to take first (-1: none)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        worth = best[c - lengths[:n]] + value[:n]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], take[c] = worth[i], i
        else:
            best[c], take[c] = best[c - 1], -1
    return best, take


def _fill(take: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Lengths by index that the knapsack puts into ``room``."""
    out: dict[int, int] = {}
    while room > 0:
        i = int(take[room])
        if i < 0:
            room -= 1
            continue
        out[i] = out.get(i, 0) + 1
        room -= int(lengths[i])
    return out


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional counts of configurations ((index of a length, times), ...) that cover the demand.

    Stops after ``ROUNDS`` rounds with whatever is covered then; the caller packs the rest.
    """
    covered = np.zeros(len(lengths))
    counts: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(ROUNDS):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            break
        size = lengths[open_]
        value = (size / capacity) ** CONVEX * np.exp(-DECAY * covered[open_])
        best, take = _knapsack(size, value, capacity)
        worth = value + best[capacity - size]
        added = np.zeros(len(open_))
        for i in np.argsort(-worth, kind="stable"):
            if worth[i] < (1 - NEAR) * worth.max() and i != len(open_) - 1:
                break
            config = _fill(take, size, capacity - int(size[i]))
            config[int(i)] = config.get(int(i), 0) + 1
            at = np.fromiter(config, dtype=np.int64)
            times = np.fromiter(config.values(), dtype=np.int64)
            want = demand[open_[at]]
            room = np.minimum(STEP, 1 - covered[open_[at]]) - added[at]
            step = float((room * want / times).min())
            if step <= 0:
                continue
            added[at] += step * times / want
            name = tuple(sorted(zip(open_[at].tolist(), times.tolist(), strict=True)))
            counts[name] = counts.get(name, 0.0) + step
        if not added.any():
            break
        covered[open_] += added
    return counts


def _round(counts: dict, demand: np.ndarray) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole counts along the running sum of the fractional ones, and the demand that is left."""
    left, total, out = demand.copy(), 0.0, []
    for config, x in sorted(counts.items(), key=lambda c: (c[0][-1][0], c[0]), reverse=True):
        n = int(total + x + 1e-9) - int(total + 1e-9)
        total += x
        n = min([n, *(int(left[i] // times) for i, times in config)])
        if n > 0:
            out.append((config, n))
            for i, times in config:
                left[i] -= n * times
    return out, left


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """Pack what is left, longest first, each into the fullest sequence that has room."""
    spaces: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, dtype=np.int64)
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        for _ in range(int(left[i])):
            fits = np.flatnonzero(filled[size:])
            room = size + int(fits[0]) if len(fits) else capacity
            if len(fits):
                held = spaces[room].pop()
                filled[room] -= 1
            else:
                held = []
            held.append(i)
            spaces[room - size].append(held)
            filled[room - size] += 1
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for held in (h for s in spaces for h in s):
        at, times = np.unique(held, return_counts=True)
        name = tuple(zip(at.tolist(), times.tolist(), strict=True))
        out[name] = out.get(name, 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations ([(length, times), ...], how many sequences) that hold every piece exactly once."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    chosen, left = _round(configuration_lp(lengths, demand, capacity), demand)
    chosen += list(_best_fit(lengths, left, capacity).items())
    return [([(int(lengths[i]), times) for i, times in config], n) for config, n in chosen]


def _cut(path: str, text_at: int, capacity: int, end_id: int, names: list[str]):
    def cut(batches):
        bpe = load(path)
        for b in batches:
            texts = b.column(text_at).to_pylist()
            for first, last in slices(texts):
                ids, counts = bpe.encode_batch([t or "" for t in texts[first:last]])
                ids = np.insert(ids, offsets(counts)[1:], end_id).astype("<u4")
                counts = counts + 1
                # only longer documents are cut, and then the first piece is the short one
                n = np.maximum(1, -(-counts // capacity))
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(offsets(n)[:-1], n)
                head = counts - (n - 1) * capacity
                start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[doc])
                data, at = ids.tobytes(), (offsets(counts)[doc] + start) * 4
                parts = [data[i:j] for i, j in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                kept = [c.take(pa.array(doc)) for c in b.slice(first, last - first).columns[:text_at]]
                columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(parts, pa.binary())], names=names)

    return returning_memory(cut)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>``, ``piece``, ``start``, ``length`` and ``ids`` (binary, unsigned 32-bit, little-endian)
    of every piece: a document's ids with ``end_id`` after them, cut if longer than ``capacity``."""
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    numbers = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    schema = T.StructType([chosen.schema[0], *numbers, T.StructField("ids", T.BinaryType())])
    return chosen.mapInArrow(_cut(path, 1, capacity, end_id, schema.names), schema)


def _slots(configs: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: rank from which a slot's pieces start, its first sequence, pieces a sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, n in configs:
        at = 0
        for length, times in config:
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, times, at))
            taken[length] = first + n * times
            at += length * times
        sequence += n
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def _place(sent, names: list[str], length_at: int, rank_at: int):
    def place(batches):
        slots = sent.value
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (length_at, rank_at))
            sequence, at = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                first, base, times, offset = slots[int(size)]
                i = np.searchsorted(first, rank[mine], side="right") - 1
                nth = rank[mine] - first[i]
                sequence[mine] = base[i] + nth // times[i]
                at[mine] = offset[i] + nth % times[i] * size
            kept = [c for j, c in enumerate(b.columns) if j != rank_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(at)], names=names)

    return returning_memory(place)


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``cut`` (as ``pieces`` makes them) with ``sequence_id`` and ``offset``.

    Every row gets one place; a sequence holds at most ``capacity`` tokens without gaps. Documents
    with null or empty text are one piece of the end id. Rows may repeat or have no id: each is
    placed. An empty table gives an empty result. ``cut`` is read three times, so it should be
    stored. The driver holds the histogram (``capacity`` counts) and the configurations, at most
    ``ROUNDS * capacity`` and one per piece that rounding leaves.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    # rank of a piece among those of its length: inside buckets, then buckets one after another
    buckets = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, buckets long")
    names = [c for c in cut.columns if c not in ("ids",)]
    spread = cut.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.col("buckets")))
    sizes = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*names)
    ranked = spread.withColumn("_rank", F.row_number().over(within) - 1).join(sizes, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_place(slots, schema.names, cut.columns.index("length"), len(cut.columns)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its whole ``ids``; a sequence has at most ``capacity`` tokens, so groups are bounded."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack: the columns of ``pack`` and ``ids_crc32``, with the ids if asked for."""
    cut = pieces(docs, path, capacity, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    return pack(stored(cut if with_ids else cut.drop("ids"), "pieces"), capacity, id_col)
