"""Text and vector retrieval over whole documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.registry.base import query
from spindrift.retrieval import text, vector
from spindrift.sources import tables

BM25 = r"""WITH toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents),
 terms AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term <> '' GROUP BY ALL),
 lens AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY 1),
 corpus AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lens),
 dfs AS (SELECT term, count(*)::DOUBLE AS df FROM terms GROUP BY 1),
 qt AS (SELECT DISTINCT item_id AS query_id, term FROM (
   SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> ''),
 scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
   / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
   FROM qt JOIN terms USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN corpus GROUP BY ALL)
"""


def index(spark, sf):
    """The documents indexed and stored; a search reads the stored index."""
    return text.store_index(text.build_index(tables.policies(spark, sf)))


@query(
    "ret01_bm25_top5",
    BM25
    + """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5""",
)
def bm25(spark, sf):
    return text.search(index(spark, sf), tables.questions(spark, sf), k=5)


@query(
    "ret02_filtered_top3",
    BM25
    + """SELECT s.query_id, s.doc_id, s.score, s.rank, d.source AS title FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM scored JOIN documents USING (doc_id) WHERE lang = 'fr') s
      JOIN documents d USING (doc_id) WHERE rank <= 3""",
)
def filtered(spark, sf):
    return text.search(
        index(spark, sf), tables.questions(spark, sf), k=3, filters={"category": "fr"}, columns=("title",)
    )


@query(
    "top08_example_limit",
    BM25
    + """SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 3""",
)
def example_limit(spark, sf):
    return text.search(index(spark, sf), tables.questions(spark, sf), k=3).select("query_id", "doc_id", "rank")


@query(
    "ret03_vector_top5",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label::BIGINT AS query_id, i, CAST(sum(CAST(x AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS x FROM e GROUP BY ALL),
    qv AS (SELECT query_id, list(x ORDER BY i) AS v FROM c GROUP BY 1),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) AS score
          FROM qv CROSS JOIN embeddings)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def vectors(spark, sf):
    """The nearest vectors to the mean vector of every label."""
    embeddings = tables.read(spark, sf, "embeddings")
    return vector.search(embeddings, vector.centroids(embeddings), k=5)


@query(
    "ret01_term_statistics",
    r"""WITH toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM toks WHERE term <> '' GROUP BY term""",
)
def term_statistics(spark, sf):
    rows = text.postings(tables.policies(spark, sf))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
