"""BM25 ranking as joins and aggregations over a term index.

The index has one row per (document, term). Document length travels with the row, so
scoring needs no second join on the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.sources import workdir

# fixed values: ranking constants and digits of the reported score
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
# fixed value: runs of letters and digits are words
SEPARATOR = r"[^\p{L}\p{N}]+"
# fixed value: about how many (query, term) pairs are sent to every executor at once
BLOCK_TERMS = 200_000
# fixed value: about how many characters of text go through one task; their postings share a bucket
CHARS_PER_TASK = 4 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def tasks(documents: DataFrame, text: str = "content") -> int:
    """Among how many tasks these texts are dealt, so that what a task holds doesn't grow with them."""
    chars = documents.agg(F.sum(F.length(text))).first()[0] or 0
    return max(1, -(-chars // CHARS_PER_TASK))


def postings(documents: DataFrame, key: str = "policy_id", text: str = "content") -> DataFrame:
    """(doc_id, term, tf, doc_len) of whole texts.

    The raw texts are hashed to their document id first. Compressed text is smaller than
    the exploded postings, the words of one document then stay in one task, and neither
    this count nor a later one per document needs another shuffle. The number of tasks follows
    the texts, since a compressed text is far smaller than the postings that a task counts.
    """
    placed = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartition(tasks(documents, text), "doc_id")
    tokens = placed.select("doc_id", words(F.col("text")).alias("w"))
    # a plain explode would let Spark repeat the tokeniser in a filter before the exchange
    return (
        tokens.select("doc_id", F.size("w").alias("doc_len"), F.explode_outer("w").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("doc_id", "doc_len", "term")
        .agg(F.count("*").alias("tf"))
    )


@dataclass(frozen=True)
class TextIndex:
    """postings(doc_id, doc_len, term, tf), documents(doc_id, doc_len, attributes...) and,
    if the index is stored, frequencies(term, df)."""

    postings: DataFrame
    documents: DataFrame
    frequencies: DataFrame | None = None

    def corpus(self) -> DataFrame:
        """Number of documents and average length, as one row."""
        return self.documents.agg(
            F.count("*").alias("n_docs"),
            (F.sum("doc_len").cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("avg_len"),
        )

    def document_frequency(self) -> DataFrame:
        if self.frequencies is not None:
            return self.frequencies
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))


def build_index(
    documents: DataFrame, key: str = "policy_id", text: str = "content", attributes: tuple[str, ...] = ("category", "title")
) -> TextIndex:
    docs = documents.select(
        F.col(key).alias("doc_id"), F.size(words(F.col(text))).alias("doc_len"), *attributes
    )
    return TextIndex(postings(documents, key, text), docs)


def store_index(index: TextIndex, buckets: int | None = None) -> TextIndex:
    """Write the index to the shared folder; postings are bucketed by document.

    A search sums term contributions per (query, document). On bucketed postings that
    grouping is already co-located, so scoring runs without moving a single posting. The
    number of buckets follows the words, so that a bucket stays as small as a task's texts.
    """
    spark = index.postings.sparkSession
    # a word and its separator are six characters, as in English
    per_corpus = -(-6 * (index.documents.agg(F.sum("doc_len")).first()[0] or 0) // CHARS_PER_TASK)
    n = buckets or max(per_corpus, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = workdir.fresh_path(spark, "text-index")
    table = "postings_" + path.rsplit("-", 1)[1]
    writer = index.postings.repartition(n, "doc_id").write.option("path", f"{path}/postings")
    writer.bucketBy(n, "doc_id").format("parquet").saveAsTable(table)
    rows = spark.table(table)
    # lengths come from the stored postings, so the texts are not read a second time
    lengths = rows.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("doc_len"))
    described = index.documents.drop("doc_len").join(lengths, "doc_id", "left")
    described.withColumn("doc_len", F.coalesce("doc_len", F.lit(0))).select(index.documents.columns).write.parquet(
        f"{path}/documents"
    )
    rows.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/frequencies")
    return TextIndex(
        rows,
        spark.read.schema(index.documents.schema).parquet(f"{path}/documents"),
        spark.read.schema("term string, df long").parquet(f"{path}/frequencies"),
    )


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    return queries.select(
        F.col(key).alias("query_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("term")
    )


def weighted_terms(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Query terms with idf and the corpus figures; terms nobody uses drop out."""
    corpus = index.corpus()
    n = corpus.select("n_docs").scalar().cast("double")
    avg_len = corpus.select("avg_len").scalar()
    df = F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return terms.join(index.document_frequency(), "term").select(
        "query_id", "term", idf.alias("idf"), avg_len.alias("avg_len")
    )


def contribution() -> Column:
    """BM25 share of one (query term, document) pair."""
    tf = F.col("tf").cast("double")
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len"))
    return F.col("idf") * tf * F.lit(K1 + 1.0) / (tf + norm)


def scores(index: TextIndex, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Score of every document that shares a term with a query.

    Query terms are sent to the postings, which stay where they are, in blocks of whole
    queries of about BLOCK_TERMS pairs; any number of queries takes the same plan.
    """
    weighted = weighted_terms(index, terms)
    rows = index.postings
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_block_scores(rows, weighted.where(block == b)) for b in range(blocks)])


def _block_scores(rows: DataFrame, weighted: DataFrame) -> DataFrame:
    hits = rows.join(F.broadcast(weighted), "term")
    return hits.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(contribution()), SCORE_DIGITS).alias("score")
    )


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k documents per query; ties go to the smaller id.

    Spark keeps at most k rows per query in each task before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(
    index: TextIndex,
    queries: DataFrame,
    k: int = 5,
    filters: dict[str, str] | None = None,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Top-k documents per query, optionally restricted by attribute and with columns.

    A filter narrows the candidates; idf and average length stay those of the corpus.
    """
    allowed = None
    if filters:
        allowed = index.documents
        for column, value in filters.items():
            allowed = allowed.where(F.col(column) == F.lit(value))
    best = top_k(scores(index, query_terms(queries), allowed), k)
    if not columns:
        return best
    return best.join(index.documents.select("doc_id", *columns), "doc_id")
