"""Exact cosine top-k over a vector column.

Vectors stay in Spark; a task turns one Arrow batch into a matrix and keeps only its
best k rows per query, so nothing of the size (queries x vectors) is ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCORE_DIGITS = 6
# fixed values: queries sent to the tasks at once, and vectors multiplied with them at once
QUERY_BLOCK = 1024
VECTOR_CHUNK = 2048
RESULT = "query_id long, vec_id long, score double"


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column) -> np.ndarray:
    return unit(np.stack([np.asarray(v, dtype=np.float64) for v in column]))


class Best:
    """Running top k per query: highest rounded score, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, dtype=np.int64)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, ids: np.ndarray, similarity: np.ndarray) -> None:
        similarity = np.round(similarity, SCORE_DIGITS)
        for i, row in enumerate(similarity):
            if len(row) > self.k:
                # everything at least as good as the k-th, so that ties are not lost
                near = np.flatnonzero(row >= np.partition(row, len(row) - self.k)[len(row) - self.k])
            else:
                near = np.arange(len(row))
            all_ids = np.concatenate([self.ids[i], ids[near]])
            all_scores = np.concatenate([self.scores[i], row[near]])
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.ids[i], self.scores[i] = all_ids[order], all_scores[order]

    def rows(self, query_ids) -> Iterator[pd.DataFrame]:
        for query, ids, scores in zip(query_ids, self.ids, self.scores, strict=True):
            if len(ids):
                yield pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores})


def _keep_k(candidates: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) for vectors(vec_id, embedding), queries(query_id, embedding).

    Queries are sent in blocks of about ``query_block``; for each block the vectors are
    scanned where they lie, in chunks of bounded size, and a task keeps its best k per query.
    """
    blocks = max(1, -(-queries.count() // query_block))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return _keep_k(reduce(DataFrame.unionByName, [_scan(vectors, queries.where(block == b).toPandas(), k) for b in range(blocks)]), k)


def _scan(vectors: DataFrame, block: pd.DataFrame, k: int) -> DataFrame:
    names = block["query_id"].tolist()
    matrix = _matrix(block["embedding"]) if names else np.zeros((0, 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, len(batch) if names else 0, VECTOR_CHUNK):
                part = batch.iloc[at : at + VECTOR_CHUNK]
                best.add(part["vec_id"].to_numpy(), matrix @ _matrix(part["embedding"]).T)
        yield from best.rows(names)

    return vectors.select("vec_id", "embedding").mapInPandas(score, RESULT)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label as queries: (query_id, embedding), summed element by element."""
    elements = vectors.select(F.col(label).cast("long").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = elements.groupBy("query_id", "i").agg(
        (F.sum(F.col("x").cast("decimal(20,10)")).cast("double") / F.count("*")).alias("x")
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))
