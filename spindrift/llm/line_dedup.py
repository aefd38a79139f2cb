"""Line dedup with exact reference counts and sharded cuckoo filters over the common lines.

A ``LineStore`` holds, per line key, the number of documents with that line (exact, one row a
key) and per shard a cuckoo filter of the keys that at least ``min_docs`` documents hold.
Inserting or deleting documents adds to or takes from the counts and moves only the keys that
cross the threshold in or out of their filter, so both are reversible. Cleaning asks the
filters; only hits meet the exact table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.common import TURN_BYTES, bounded_batches, join_spread, returning_memory, stored, turns, write
from spindrift.llm.cuckoo import CuckooFilter

#: Common lines that one filter is laid out for.
SHARD_KEYS = 1 << 18
_REFS = "shard int, key binary, n_docs long"
_FILTERS = "shard int, filter binary"


def line_key(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def keyed_lines(text: str | None, min_points: int) -> list[bytes | None]:
    r"""Key of each \n-separated line, or None for lines shorter than ``min_points`` once stripped.

    bytes.lower() and bytes.strip() touch A-Z and ASCII white space only, which is the rule here.
    """
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    stripped = [x.strip(b" \t\n\x0b\x0c\r") for x in lines]
    return [line_key(x) if len(x) >= min_points and (min_points <= 1 or len(x.decode("utf-8", "replace")) >= min_points) else None for x in stripped]


def _count(min_points: int):
    def count(batches):
        for b in batches:
            found: Counter[bytes] = Counter()
            for text in b.column(0).to_pylist():
                found.update({k for k in keyed_lines(text, min_points) if k is not None})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["key", "n_docs"])

    return returning_memory(count)


def _shard(shards: int):
    """The first four bytes of a key choose its shard."""
    return (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards).cast("int")


@dataclass(frozen=True)
class LineStore:
    """One immutable version of the counts and filters; changes return the next version."""

    spark: SparkSession
    refs_path: str
    filters_path: str
    shards: int
    min_docs: int
    min_points: int

    def refs(self) -> DataFrame:
        return self.spark.read.schema(_REFS).parquet(self.refs_path)

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(self.filters_path)

    def common(self) -> DataFrame:
        return self.refs().where(F.col("n_docs") >= self.min_docs)

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_points: int = 1) -> LineStore:
        """Count the lines of ``docs``; the number of shards follows the number of common lines."""
        counts = stored(line_counts(docs, text_col, min_points), "line-counts")
        shards = max(1, -(-counts.where(F.col("n_docs") >= min_docs).count() // SHARD_KEYS))
        spark = docs.sparkSession
        empty = cls(spark, write(spark.createDataFrame([], _REFS), "refs"), write(spark.createDataFrame([], _FILTERS), "filters"), shards, min_docs, min_points)
        return empty._changed(counts)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        return self._changed(line_counts(docs, text_col, self.min_points))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineStore:
        """Take back documents that were inserted; fails for lines that never were."""
        return self._changed(line_counts(docs, text_col, self.min_points).withColumn("n_docs", -F.col("n_docs")))

    def _changed(self, change: DataFrame) -> LineStore:
        both = self.refs().select("key", F.col("n_docs").alias("old"), F.lit(0).cast("long").alias("plus")).unionByName(change.select("key", F.lit(0).cast("long").alias("old"), F.col("n_docs").alias("plus")))
        summed = both.groupBy("key").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("plus")).alias("n_docs")).withColumn("shard", _shard(self.shards))
        summed = stored(summed, "line-sums")
        checked = F.when(F.col("n_docs") >= 0, F.col("n_docs")).otherwise(F.raise_error(F.lit("a deleted document was never inserted")).cast("long"))
        refs = write(summed.select("shard", "key", checked.alias("n_docs")).where(F.col("n_docs") > 0), "refs")

        now, was = F.col("n_docs") >= self.min_docs, F.col("old") >= self.min_docs
        crossed = summed.where(now != was).select("shard", "key", now.alias("up"), F.lit(False).alias("whole"))
        # filters that would be too full are laid out anew from the exact table
        need = summed.where(now).groupBy("shard").agg(F.count("*").alias("need"))
        room = self.filters().select("shard", (F.lit(_room_per_byte) * F.length("filter")).alias("room"))
        full = need.join(room, "shard", "left").where(F.coalesce(F.col("room"), F.lit(0.0)) < F.col("need")).select("shard")
        whole = summed.where(now).join(full, "shard", "left_semi").select("shard", "key", F.lit(True).alias("up"), F.lit(True).alias("whole"))
        changes = crossed.join(full, "shard", "left_anti").unionByName(whole)
        updated = changes.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_update, _FILTERS)
        return LineStore(self.spark, refs, write(updated, "filters"), self.shards, self.min_docs, self.min_points)


#: Keys for which a filter has room, for each of its bytes: 2 bytes a slot, filled to LOAD.
_room_per_byte = 0.85 / 2


def _update(key, changes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    if len(changes) and changes["whole"].any():
        keys = list(changes["key"])
        cuckoo = CuckooFilter(2 * len(keys))
        cuckoo.insert(keys)
    else:
        cuckoo = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(1)
        cuckoo.delete(list(changes.loc[~changes["up"].astype(bool), "key"]))
        cuckoo.insert(list(changes.loc[changes["up"].astype(bool), "key"]))
    return pd.DataFrame({"shard": [int(key[0])], "filter": [cuckoo.to_bytes()]})


def line_counts(docs: DataFrame, text_col: str = "text", min_points: int = 1) -> DataFrame:
    """``key`` and ``n_docs``: in how many rows of ``docs`` a line occurs, counted per batch first."""
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(min_points), "key binary, n_docs long")
    return parts.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def _hits(sent, shards: int, min_points: int):
    def hits(batches):
        filters = {s: CuckooFilter.from_bytes(b) for s, b in sent.value.items()}
        for b in batches:
            of, keys = [], []
            for text in b.column(0).to_pylist():
                mine = {k for k in keyed_lines(text, min_points) if k is not None}
                keys.extend(mine)
                of.extend([text_key(text)] * len(mine))
            shard = [int.from_bytes(k[:4], "big") % shards for k in keys]
            out_of, out_key = [], []
            for s in set(shard) & set(filters):
                at = [i for i, x in enumerate(shard) if x == s]
                found = filters[s].contains([keys[i] for i in at])
                out_of += [of[i] for i, hit in zip(at, found, strict=True) if hit]
                out_key += [keys[i] for i, hit in zip(at, found, strict=True) if hit]
            yield pa.RecordBatch.from_arrays([pa.array(out_of, pa.binary()), pa.array(out_key, pa.binary())], names=["text_key", "key"])

    return returning_memory(hits)


def text_key(text: str | None) -> bytes:
    """Digest of a text, the same as Spark's ``md5`` of it."""
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _drop(min_points: int):
    def drop(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, gone = (text or "").split("\n"), set(keys or ())
                stay = [x for x, k in zip(lines, keyed_lines(text, min_points), strict=True) if k not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])

    return returning_memory(drop)


def drop_common_lines(docs: DataFrame, store: LineStore, id_col: str = "doc_id", text_col: str = "text", turn_bytes: int = TURN_BYTES) -> DataFrame:
    """``row`` (a struct of the input columns but the text), ``n_lines``, ``n_dropped`` and ``kept_text``.

    One row per input row. A line is dropped if its key (ASCII white space stripped at both ends,
    A-Z lower-cased, at least ``min_points`` code points) is held by ``min_docs`` documents of the
    store. Null and empty texts are one empty line, which is shorter than one code point and so
    stays. Rows that are repeated or have no id count as documents like any other. A text whose
    lines all go becomes empty with ``n_dropped = n_lines``. An empty table gives an empty result.
    Input columns may have any names, as they travel inside ``row``.

    Filters reach the tasks in turns of at most ``turn_bytes``; each turn reads the texts once.
    """
    spark = docs.sparkSession
    texts = bounded_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    filters = store.filters()
    largest = filters.agg(F.max(F.length("filter"))).first()[0] or 1
    hits = None
    for mine in turns(store.shards, largest, turn_bytes):
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.where(F.col("shard").between(mine.start, mine.stop - 1)).collect()})
        part = texts.mapInArrow(_hits(sent, store.shards, store.min_points), "text_key binary, key binary")
        hits = part if hits is None else hits.unionByName(part)
    # copies of a text give the same hits; they are counted, not repeated
    pairs = stored(hits.groupBy("text_key", "key").agg(F.count("*").alias("copies")), "line-hits")
    common = store.common().select("key", "n_docs")
    true = join_spread(pairs, common, "key", "n_docs", ["n_docs"], F.col("text_key")).where(F.col("n_docs").isNotNull())
    verdict = stored(true.groupBy("text_key").agg(F.collect_list("key").alias("drop"), F.max("copies").alias("copies")), "line-verdicts")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    keyed = docs.select(rest.alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    judged = join_spread(keyed, verdict, "text_key", "copies", ["drop"], F.col("row")[id_col])
    result = T.StructType([keyed.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return judged.select("row", "text", "drop").mapInArrow(_drop(store.min_points), result)
