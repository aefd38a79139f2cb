"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine check, components.

Every vector goes into one bucket per table, named by the signs of its products with ``k``
hyperplanes. Pairs of a bucket are compared by an independent 256-bit sign sketch first; only
pairs that can be similar meet their vectors. The number of hyperplanes grows with the logarithm
of the number of vectors, which keeps buckets small, and the number of tables follows from the
chance of missing a pair at the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_spread, mix64, offsets, ragged, stored
from spindrift.llm.components import components

SKETCH_BITS = 256
#: Standard deviations above the expected sketch distance at the threshold that a pair may show.
SLACK = 6.0
#: Rows of a bucket that are compared with one another in one group; larger buckets are cut into blocks.
BLOCK = 512
#: Pairs compared at once.
PAIRS = 1 << 19


def layout(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Hyperplanes per table and number of tables for ``n`` vectors."""
    planes = min(40, max(6, math.ceil(math.log2(max(n, 2))) - 3))
    together = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def _planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count]).standard_normal((dim, count))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles of a list column and the length of each list."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0, lengths


def _content(batches):
    for b in batches:
        flat, lengths = _matrix(b.column(1))
        ends = offsets(lengths).tolist()
        keys = [xxhash.xxh3_128_digest(flat[i:j].tobytes()) for i, j in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "content"])


def _sign(planes: int, tables: int, seed: int):
    def sign(batches):
        for b in batches:
            flat, lengths = _matrix(b.column(1))
            starts = offsets(lengths)[:-1]
            keys, sketch = np.zeros((len(lengths), tables), dtype=np.uint64), np.zeros((len(lengths), SKETCH_BITS // 8), dtype=np.uint8)
            for dim in np.unique(lengths):
                mine = np.flatnonzero(lengths == dim)
                x = flat[ragged(starts[mine], lengths[mine])].reshape(len(mine), dim)
                # dividing by the largest entry keeps products finite and changes no sign
                x = x / np.abs(x).max(axis=1, keepdims=True)
                bits = (x @ _planes(int(dim), planes * tables, seed) > 0).reshape(len(mine), tables, planes)
                code = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(planes, dtype=np.uint64))
                with np.errstate(over="ignore"):
                    table = mix64(np.arange(tables, dtype=np.uint64) + np.uint64(dim) * np.uint64(1 << 32))
                    keys[mine] = mix64(code + table[None, :])
                sketch[mine] = np.packbits(x @ _planes(int(dim), SKETCH_BITS, seed + 1) > 0, axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), listed, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["id", "keys", "sketch"])

    return sign


def _pair_up(limit: int):
    """Rows (bucket, i, j, own, id, sketch) sorted by group: pairs of a group within ``limit`` bits."""

    def pairs(group: np.ndarray, own: np.ndarray, across: np.ndarray, ids: pa.Array, sketch: np.ndarray):
        # each row meets the later rows of its group; of two different blocks only rows of the other
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)) if len(group) else np.zeros(0, dtype=np.int64)
        end = np.repeat(ends, np.diff(np.append(0, ends)))
        later = end - np.arange(len(group)) - 1
        upto = offsets(later)
        at = 0
        while at < len(group):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, side="right")) - 1)
            x = np.repeat(np.arange(at, to), later[at:to])
            y = ragged(np.arange(at, to) + 1, later[at:to])
            use = ~across[x] | (own[x] != own[y])
            x, y = x[use], y[use]
            far = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1)
            near = far <= limit
            if near.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[near])), ids.take(pa.array(y[near]))], names=["a", "b"])
            at = to

    def run(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            group = b.column("group").to_numpy()
            last = int(np.searchsorted(group, group[-1], side="left")) if len(group) else 0
            held = b.slice(last)
            if last:
                yield from one(b.slice(0, last))
        if held is not None and held.num_rows:
            yield from one(held)

    def one(t: pa.Table):
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
        yield from pairs(t.column("group").to_numpy(), t.column("own").to_numpy(), t.column("across").to_numpy(), t.column("id").combine_chunks(), sketch)

    return run


def _cosine(threshold: float):
    def cosine(batches):
        for b in batches:
            (x, n), (y, m) = _matrix(b.column(2)), _matrix(b.column(3))
            keep = np.zeros(b.num_rows, dtype=bool)
            same = n == m
            sx, sy = offsets(n)[:-1], offsets(m)[:-1]
            for dim in np.unique(n[same]):
                at = np.flatnonzero(same & (n == dim))
                p, q = x[ragged(sx[at], n[at])].reshape(-1, dim), y[ragged(sy[at], m[at])].reshape(-1, dim)
                p, q = (v / np.abs(v).max(axis=1, keepdims=True) for v in (p, q))
                keep[at] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)) >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return cosine


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-5, seed: int = 20240229) -> DataFrame:
    """``<id_col>``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Two vectors are linked if their cosine, in double precision, is at least ``threshold``. No
    pair below it is linked; a pair at it is missed with probability ``miss``, a closer pair less
    often. ``n_links`` counts the other rows that are linked directly, equal vectors among them.
    ``component_id`` is the smallest id that links lead to.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Rows without an id link with nothing, stay, and have a
    null component. Rows that repeat an id are one vector; if their vectors differ, each result
    row takes the smallest component and the largest count of them. Equal vectors are one node, so
    a group of copies never meets itself in pairs. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    kind = rows.schema["id"].dataType.simpleString()
    usable = rows.where(good)

    named = stored(usable.mapInArrow(_content, f"id {kind}, content binary").distinct(), "contents")
    nodes = stored(named.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "nodes")
    held = stored(usable.join(nodes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "vectors")
    planes, tables = layout(nodes.count(), threshold, miss)

    signed = stored(held.mapInArrow(_sign(planes, tables, seed), f"id {kind}, keys array<long>, sketch binary"), "signs")
    placed = signed.select("id", "sketch", F.explode("keys").alias("bucket"))
    sizes = stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    sized = join_spread(placed, sizes, "bucket", "n", ["n"], F.col("id")).where("n is not null")
    # a bucket of more than BLOCK rows is compared block against block
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = sized.withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    grouped = sized.select(F.xxhash64("bucket", first, second).alias("group"), "own", (first != second).alias("across"), "id", "sketch")
    p = math.acos(threshold) / math.pi
    limit = math.ceil(SKETCH_BITS * p + SLACK * math.sqrt(SKETCH_BITS * p * (1 - p)))
    met = grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_pair_up(limit), f"a {kind}, b {kind}")
    near = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "near-pairs")

    links = stored(_with(_with(near, held, "a"), held, "b").mapInArrow(_cosine(threshold), f"a {kind}, b {kind}"), "links")
    return _answer(vectors, id_col, named, nodes, links)


def _with(pairs: DataFrame, held: DataFrame, end: str) -> DataFrame:
    """Add the vector at one end of each pair; a vector in many pairs is spread."""
    many = pairs.groupBy(end).agg(F.count("*").alias("n"))
    looked = held.withColumnRenamed("id", end).join(many, end).select(end, "n", F.col("vector").alias(f"vector_{end}"))
    return join_spread(pairs, looked, end, "n", [f"vector_{end}"], F.xxhash64("a", "b"))


def _answer(vectors: DataFrame, id_col: str, named: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(nodes.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("outside"))
    per_node = nodes.join(counts, F.col("rep") == F.col("a"), "left").join(components(links), F.col("rep") == F.col("node"), "left")
    per_node = stored(per_node.select("content", "copies", (F.coalesce("outside", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per-node")
    found = join_spread(named, per_node, "content", "copies", ["n_links", "component_id"], F.col("id"))
    found = found.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")).withColumnRenamed("id", id_col)
    out = vectors.select(id_col).join(found, id_col, "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))
