"""Keep the text index fresh from newly dropped document files.

Each micro-batch compares its documents with the newest stored version by content hash. Only
changed texts are tokenised and write postings, under the batch's id; an unchanged text writes one
document row that points to the postings it already has, and a withdrawn document one row that
says so. Nothing that exists is rewritten: a replayed batch compares with the batches before it
and overwrites only its own folders, so the result is exactly-once, and a reader takes the newest
version of every document; versions that arrive late lose, and between equal versions the later
batch wins. ``compact`` folds the batches together when there are many; ``lag`` tells how far the
index was behind.
"""

from __future__ import annotations

import threading
from collections import deque
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from spindrift.retrieval.text import TextIndex, postings, tasks, words

POSTINGS = "doc_id long, doc_len int, term string, tf long, batch long"
DOCUMENTS = "doc_id long, doc_len int, category string, title string, version long, digest string, live boolean, at long, batch long"
BATCHES = "changed long, unchanged long, withdrawn long, arrived timestamp, applied timestamp, batch long"
# fixed value: how often the index is brought up to date
REFRESH_INTERVAL = "1 hour"
#: Optional columns of a batch: the document is taken back; when its file came.
WITHDRAWN, ARRIVED = "withdrawn", "arrived"
#: Batches whose progress a listener remembers.
REMEMBERED = 10_000


def newest_version(batch: DataFrame, order: str | None) -> DataFrame:
    """One row per document when a batch holds several versions of it."""
    others = [c for c in batch.columns if c != "policy_id"]
    rank = F.struct(*([order] if order else []), F.struct(*others))
    best = F.max_by(F.struct(*others), rank).alias("d")
    return batch.repartition(tasks(batch), "policy_id").groupBy("policy_id").agg(best).select("policy_id", "d.*")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _stored(spark: SparkSession, index_dir: str, before: int | None = None) -> DataFrame:
    """Newest row of every document, of the batches in front of ``before``."""
    if not _exists(spark, f"{index_dir}/documents"):
        return spark.createDataFrame([], DOCUMENTS)
    rows = spark.read.schema(DOCUMENTS).parquet(f"{index_dir}/documents")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    names = [c for c in rows.columns if c != "doc_id"]
    newest = F.max_by(F.struct(*names), F.struct("version", "batch")).alias("d")
    return rows.groupBy("doc_id").agg(newest).select("doc_id", "d.*")


def apply_batch(batch: DataFrame, batch_id: int, index_dir: str, order: str | None = None) -> None:
    """Index the documents of one micro-batch under ``batch=<batch_id>``.

    ``order`` names a numeric column that tells versions apart; without it they count as equal. A
    true ``withdrawn`` takes a document back.
    """
    spark = batch.sparkSession
    # the texts are measured first: a source is read once all the same
    batch.persist()
    rows = batch if WITHDRAWN in batch.columns else batch.withColumn(WITHDRAWN, F.lit(False))
    rows = rows if ARRIVED in batch.columns else rows.withColumn(ARRIVED, F.lit(None).cast("timestamp"))
    rows = newest_version(rows, order).withColumn(WITHDRAWN, F.coalesce(WITHDRAWN, F.lit(False)))
    digest = F.sha2(F.coalesce(F.col("content"), F.lit("")), 256)
    held = _stored(spark, index_dir, batch_id).where("live").select(F.col("doc_id").alias("policy_id"), F.col("digest").alias("_digest"), F.col("at").alias("_at"), F.col("doc_len").alias("_len"))
    told = rows.withColumn("digest", digest).join(held, "policy_id", "left").withColumn("_same", F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False)) & ~F.col(WITHDRAWN))
    told.persist()
    try:
        changed = told.where(~F.col("_same") & ~F.col(WITHDRAWN))
        postings(changed).write.mode("overwrite").parquet(f"{index_dir}/postings/batch={batch_id}")
        version = (F.col(order) if order else F.lit(0)).cast("long").alias("version")
        length = F.when(F.col("_same"), F.col("_len")).when(F.col(WITHDRAWN), 0).otherwise(F.size(words(F.coalesce(F.col("content"), F.lit("")))))
        at = F.when(F.col("_same"), F.col("_at")).otherwise(F.lit(batch_id)).cast("long")
        listed = told.select(F.col("policy_id").alias("doc_id"), length.alias("doc_len"), "category", "title", version, "digest", (~F.col(WITHDRAWN)).alias("live"), at.alias("at"))
        counts = told.agg(
            F.count_if(~F.col("_same") & ~F.col(WITHDRAWN)).alias("changed"),
            F.count_if("_same").alias("unchanged"),
            F.count_if(WITHDRAWN).alias("withdrawn"),
            F.max(ARRIVED).alias("arrived"),
            F.current_timestamp().alias("applied"),
        )
        # the document list is written after the postings: a reader sees a document only with them
        listed.write.mode("overwrite").parquet(f"{index_dir}/documents/batch={batch_id}")
        counts.write.mode("overwrite").parquet(f"{index_dir}/batches/batch={batch_id}")
    finally:
        told.unpersist()
        batch.unpersist()


def start(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    index_dir: str,
    checkpoint_dir: str,
    once: bool = True,
    order: str | None = None,
    prepare=None,
    max_files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start the refresh. ``once`` handles everything available and stops; otherwise the
    stream wakes up every REFRESH_INTERVAL. ``prepare`` maps raw rows to policy columns."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_batch).parquet(source)
    raw = raw.select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))
    documents = prepare(raw) if prepare else raw
    writer = documents.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(
        lambda batch, batch_id: apply_batch(batch, batch_id, index_dir, order)
    )
    trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=REFRESH_INTERVAL)
    return trigger.start()


class Progress(StreamingQueryListener):
    """Remembers what each micro-batch read and how long it took; ``table`` gives it as rows."""

    SCHEMA = "query string, batch long, rows long, started timestamp, seconds double"

    def __init__(self) -> None:
        self._rows: deque = deque(maxlen=REMEMBERED)
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        started = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        with self._lock:
            self._rows.append((str(p.id), p.batchId, p.numInputRows, started, p.batchDuration / 1000.0))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def table(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), self.SCHEMA)


def lag(spark: SparkSession, index_dir: str) -> DataFrame:
    """Per batch what it did and ``lag_seconds``, from the arrival of its newest file to the index."""
    rows = spark.read.schema(BATCHES).parquet(f"{index_dir}/batches")
    return rows.withColumn("lag_seconds", F.col("applied").cast("double") - F.col("arrived").cast("double"))


def _current(spark: SparkSession, index_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings of the documents that are live in their newest version, and the newest rows of all."""
    current = _stored(spark, index_dir)
    rows = spark.read.schema(POSTINGS).parquet(f"{index_dir}/postings")
    live = rows.join(current.where("live").select("doc_id", F.col("at").alias("batch")), ["doc_id", "batch"], "left_semi")
    return live.drop("batch"), current.drop("batch")


def read_index(spark: SparkSession, index_dir: str) -> TextIndex:
    """The current index: for every document that is not withdrawn the rows of its newest version."""
    rows, documents = _current(spark, index_dir)
    return TextIndex(rows, documents.where("live").drop("version", "digest", "live", "at"))


def compact(spark: SparkSession, index_dir: str, target_dir: str) -> TextIndex:
    """Write the current index as one batch, older than any that a stream writes, into a new folder.

    The refresh continues there; versions, digests and withdrawals are kept, so late older rows lose
    and unchanged texts are known as before. The old folder stays readable until its readers are done.
    """
    rows, documents = _current(spark, index_dir)
    rows.write.mode("overwrite").parquet(f"{target_dir}/postings/batch=-1")
    documents.withColumn("at", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{target_dir}/documents/batch=-1")
    return read_index(spark, target_dir)
