"""Exact dedup with two passes over Bloom filters.

Pass one turns every row into a few bits of two filters, ``seen`` and ``again``, per shard of
the hash space; filters merge as ``again |= other.again | (seen & other.seen)``. Pass two asks
``again`` about every row: rows it has never seen twice pass straight through, the others are
shuffled and compared by SHA-256. There are no false negatives; a false positive only costs a
row in the shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import TURN_BYTES, join_spread, mix64, turns, write

SHARD_BITS = 1 << 23
#: Filters of one shard that are merged by one task.
FAN_IN = 32
_BLOCK = "shard int, part int, seen binary, again binary"


def _positions(h: np.ndarray, hashes: int) -> np.ndarray:
    """Bit positions inside a shard, one column per hash function."""
    first = mix64(h)
    step = mix64(first) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(first + np.uint64(i) * step) % np.uint64(SHARD_BITS) for i in range(hashes)], axis=1).astype(np.int64)


def _bitmap(positions: np.ndarray) -> bytes:
    bits = np.zeros(SHARD_BITS, dtype=bool)
    bits[positions.ravel()] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _bytes(bitmap: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)


def _build(hashes: int):
    def build(batches):
        held = [(b.column("shard").to_numpy(), b.column("h").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        shard, h = (np.concatenate(x) for x in zip(*held, strict=True))
        part = TaskContext.get().partitionId()
        for s in np.unique(shard):
            values, n = np.unique(h[shard == s].view(np.uint64), return_counts=True)
            at = _positions(values, hashes)
            row = [[int(s)], [part], [_bitmap(at)], [_bitmap(at[n > 1])]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary())], names=["shard", "part", "seen", "again"])

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(SHARD_BITS // 8, dtype=np.uint8)
    again = seen.copy()
    for s, a in zip(pdf["seen"], pdf["again"], strict=True):
        other = _bytes(s)
        again |= _bytes(a) | (seen & other)
        seen |= other
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "seen": [zlib.compress(seen.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]})


def _ask(filters, hashes: int):
    def ask(batches):
        known = {s: _bytes(b) for s, b in filters.value.items()}
        for b in batches:
            shard, h = b.column("shard").to_numpy(), b.column("h").to_numpy().view(np.uint64)
            maybe = np.zeros(len(h), dtype=bool)
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                at = _positions(h[mine], hashes)
                maybe[mine] = ((known[int(s)][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sha"), pa.array(maybe)], names=["id", "sha", "maybe"])

    return ask


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 4, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """One row per input row: ``<id_col>``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; null counts as the empty text, so empty and null texts form
    one group. Of a group the largest id stays. Rows without an id count in ``group_size`` and
    stay only if no row of their group has an id. Rows that repeat the kept id are all marked
    kept. Texts of any length are hashed whole; an empty table gives an empty result. Other
    columns are ignored, whatever their names.

    The filters take ``bits_per_row`` bits a row in shards of 1 MiB; they are sent to the tasks
    in turns of at most ``turn_bytes``, each over its own shards of a narrow table.
    """
    spark = docs.sparkSession
    shards = max(1, -(-docs.count() * bits_per_row // SHARD_BITS))
    groups = list(turns(shards, SHARD_BITS // 8, turn_bytes))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h"))
    narrow = narrow.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 20), F.lit(shards)).cast("int")).withColumn("turn", (F.col("shard") / len(groups[0])).cast("int"))
    narrow = spark.read.schema(narrow.schema).parquet(write(narrow, "hashes", "turn"))

    blocks = narrow.select("shard", "h").mapInArrow(_build(hashes), _BLOCK)
    parts = narrow.rdd.getNumPartitions()
    while True:
        blocks = blocks.groupBy("shard", F.floor(F.col("part") / FAN_IN)).applyInPandas(_merge, _BLOCK)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    filters = spark.read.schema("shard int, again binary").parquet(write(blocks.select("shard", "again"), "filters"))

    asked = None
    for turn, mine in enumerate(groups):
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["again"]) for r in filters.where(F.col("shard").between(mine.start, mine.stop - 1)).collect()})
        part = narrow.where(F.col("turn") == turn).select("id", "sha", "h", "shard").mapInArrow(_ask(sent, hashes), f"id {narrow.schema['id'].dataType.simpleString()}, sha binary, maybe boolean")
        asked = part if asked is None else asked.unionByName(part)
    rows = spark.read.schema(asked.schema).parquet(write(asked, "asked", "maybe"))

    straight = rows.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    suspects = rows.where("maybe").select("id", F.hex("sha").alias("sha"))
    sizes = suspects.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    shuffled = join_spread(suspects, sizes, "sha", "group_size", ["keep_id", "group_size"], F.col("id")).select("id", "keep_id", "group_size", F.unhex("sha").alias("sha"))
    return straight.unionByName(shuffled).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
