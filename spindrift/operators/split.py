"""Train / validation / test splits that give the same rows on every run.

No split ranks a whole class or the whole table in one task: running counts of small
groups tell where a share ends, and ranks are taken inside a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.numeric import uniform

# fixed value: hash buckets per class; one bucket holds about 1/4096 of its class
BUCKETS = 4096


def hash_split(key: str, train: float = 0.70, validation: float = 0.15, salt: str = "split") -> Column:
    """TRAIN / VALIDATION / TEST from one draw per key."""
    u = uniform(key, salt=salt)
    return (
        F.when(u < train, "TRAIN").when(u < train + validation, "VALIDATION").otherwise("TEST")
    )


def chronological_split(
    df: DataFrame, day: str, tiebreak: list[str], train_percent: int = 80
) -> DataFrame:
    """Oldest ``train_percent`` % of the rows are TRAIN; ``rn`` is the global position.

    Equal to a global ROW_NUMBER over (day, tiebreak), but only the per-day counts (one
    row per calendar day) pass through an unpartitioned window; rows are ranked within
    their own day.
    """
    everything = Window.partitionBy()
    earlier = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    per_day = (
        df.groupBy(day)
        .agg(F.count("*").alias("_n"))
        .select(
            day,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(everything).alias("total"),
        )
    )
    within = Window.partitionBy(day).orderBy(*tiebreak)
    rank = (F.col("_before") + F.row_number().over(within)).alias("rn")
    ranked = df.join(per_day, day).select(*df.columns, "total", rank)
    in_train = F.col("rn") * 100 <= F.col("total") * train_percent
    return ranked.withColumn("split", F.when(in_train, "TRAIN").otherwise("TEST"))


def stratified_split(
    df: DataFrame, label: str, key: list[str], train_percent: int = 80, salt: str = "42"
) -> DataFrame:
    """Exactly floor(train_percent % of n) TRAIN rows in every class, in hash order.

    Rows are counted by (class, hash bucket). In each class the share ends inside one bucket: the
    buckets in front of it are TRAIN and those behind it TEST, so only the rows of that bucket (about
    one in BUCKETS) are ranked, and no other row is shuffled or sorted. One row a class is sent to
    the tasks. Rows without a class are left out.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("_u", uniform(*key, salt=salt)).withColumn(
        "_bucket", F.floor(F.col("_u") * BUCKETS).cast("int")
    )
    by_class = Window.partitionBy(label)
    earlier = by_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        hashed.groupBy(label, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            label,
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.floor(F.sum("_n").over(by_class) * train_percent / 100).alias("_quota"),
        )
    )
    # the last bucket with TRAIN rows (none: no row is TRAIN), and how many it has
    last = F.max(F.when(F.col("_before") < F.col("_quota"), F.struct("_bucket", (F.col("_quota") - F.col("_before")).alias("_left"))))
    edges = counted.groupBy(label).agg(last.alias("_last")).select(label, F.col("_last._bucket").alias("_edge"), F.col("_last._left").alias("_left"))
    marked = hashed.join(F.broadcast(edges), label)
    on_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_u", *key))

    def sided(rows: DataFrame, in_train: Column) -> DataFrame:
        return rows.withColumn("split", F.when(in_train, "TRAIN").otherwise("TEST")).select(*df.columns, "split")

    return sided(marked.where(~on_edge), F.col("_bucket") < F.col("_edge")).unionAll(
        sided(marked.where(on_edge), rank <= F.col("_left"))
    )
