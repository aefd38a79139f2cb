"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, write


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``edges`` (columns a, b).

    Loops and repeated edges are allowed, rows with a null end are ignored, and an empty table
    gives an empty result. Each round is three aggregations and two joins; rounds grow with the
    logarithm of the number of nodes. The edge table of a round is written to the shared folder
    and the one before it deleted. Nothing but one row a round reaches the driver. A node with
    many edges never gathers them in one task: minima are aggregated partially and stored, and
    joining them back is a plain join of two tables, whose large partitions Spark splits.
    """
    spark = edges.sparkSession
    first = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b").distinct()
    path = write(first, "edges")
    schema = first.schema
    while True:
        held = spark.read.schema(schema).parquet(path)
        if _only_stars(held):
            break
        used = [path]
        step = _small_star(_large_star(held, used), used)
        path = write(step, "edges")
        for old in used:
            discard(spark, old)
    # every edge now leads from a node to the smallest node of its component
    result = held.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return result.unionByName(held.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or led to by a single centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("led")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("led")))
    roles = ends.groupBy("node").agg(F.sum("led").alias("led"), F.min("led").alias("least"))
    return roles.where((F.col("led") > 1) | ((F.col("led") == 1) & (F.col("least") == 0))).isEmpty()


def _kept(df: DataFrame, used: list[str]) -> DataFrame:
    used.append(write(df, "star"))
    return df.sparkSession.read.schema(df.schema).parquet(used[-1])


def _large_star(edges: DataFrame, used: list[str]) -> DataFrame:
    """Lead every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    around = _kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), used)
    return _kept(both.where("v > u").join(around, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), used)


def _small_star(edges: DataFrame, used: list[str]) -> DataFrame:
    """Lead a node and its smaller neighbours to the smallest of them; edges go from a to a larger b."""
    around = _kept(edges.groupBy("b").agg(F.min("a").alias("m")), used)
    moved = edges.join(around, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(around.select(F.col("m").alias("a"), "b")).distinct()
