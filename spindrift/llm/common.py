"""Helpers shared by the operators: work tables, joins on hot keys, bounded shipping, ragged arrays."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.workdir import fresh_path

#: Keys that are joined by broadcast because they are the heaviest; a fixed number at any size.
HEAVY_KEYS = 256
#: Bytes that are sent to all tasks at once; larger structures are shipped in several turns.
TURN_BYTES = 64 << 20
#: Bytes of an Arrow batch between Spark and Python, so that long texts don't make batches of gigabytes.
BATCH_BYTES = 4 << 20


def write(df: DataFrame, label: str, partition_by: str | None = None) -> str:
    """Write a work table to the shared folder; returns its path."""
    path = fresh_path(df.sparkSession, label)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return path


def bounded_batches(df: DataFrame) -> DataFrame:
    """Have the session cut Arrow batches by bytes, unless it cuts them smaller already; returns ``df``."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", df.sparkSession.conf.get(setting))) > BATCH_BYTES:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df


def returning_memory(run: Callable) -> Callable:
    """``run`` over the batches of a task, giving freed memory back to the system at its end.

    Python workers serve one stage after another; what their allocators keep of this one would
    come on top of what the next one needs.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, label))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, weight: str, payload: list[str], spread: Column) -> DataFrame:
    """Left join of many rows with one row per key, safe for keys that hold a large share.

    The ``HEAVY_KEYS`` keys of largest ``weight`` are looked up in a broadcast of that fixed
    number of rows; their rows then go to partitions chosen by ``spread`` instead of by the
    key, so no task gets all rows of one key. ``per_key`` must be cheap to read twice.
    """
    found = F.struct(*payload)
    kind = rows.schema[key].dataType.simpleString()
    # a stand-in may equal a true key: that row keeps its heavy match, and no key has two rows
    elsewhere = F.xxhash64(spread) if kind == "bigint" else F.concat(F.lit("~"), F.xxhash64(spread).cast("string")).cast(kind)
    heavy = per_key.orderBy(F.desc(weight), key).limit(HEAVY_KEYS).select(F.col(key).alias("_hk"), found.alias("_heavy"))
    light = per_key.select(F.col(key).alias("_lk"), found.alias("_light"))
    split = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    split = split.withColumn("_at", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(elsewhere))
    joined = split.join(light, F.col("_at") == F.col("_lk"), "left").withColumn("_got", F.coalesce("_heavy", "_light"))
    return joined.select(*rows.columns, *[F.col("_got")[c].alias(c) for c in payload])


def turns(n_shards: int, shard_bytes: int, turn_bytes: int = TURN_BYTES) -> Iterator[range]:
    """Consecutive ranges of shards whose bytes together stay within ``turn_bytes``."""
    per = max(1, turn_bytes // max(1, shard_bytes))
    for first in range(0, n_shards, per):
        yield range(first, min(n_shards, first + per))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, a bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each range and, last, the end of all."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
