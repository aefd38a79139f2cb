"""Table writers: create-or-replace, snapshot, append, refresh and views.

Every writer takes a path and returns the table read back, so results can be checked
and chained. Sorting before a write is deliberately absent: a stored table has no order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Create the table from a query, replacing what was there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def snapshot_once(df: DataFrame, path: str) -> DataFrame:
    """Create the table only if it does not exist; an existing one is left alone."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> DataFrame:
    """Add rows by column name."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Full refresh: empty the table, then insert. One overwrite does both."""
    return replace_table(df, path)


def bucketed_table(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Catalog table bucketed by its join key, so that later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def create_view(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return spark.table(name)


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, for clients that read rows."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*df.columns)).alias("row"))
