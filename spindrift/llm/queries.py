"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, toxicity
from spindrift.llm.embedding_dedup import embedding_dedup
from spindrift.llm.exact_dedup import exact_dedup
from spindrift.llm.fill_in_middle import fill_in_middle
from spindrift.llm.line_dedup import LineStore, drop_common_lines
from spindrift.llm.minhash import near_dedup
from spindrift.llm.packing import pack_documents
from spindrift.llm.periodic_runs import periodic_runs
from spindrift.llm.pii import KINDS, find_personal_data, joined
from spindrift.llm.prefix_free import remove_repeated
from spindrift.llm.quality import score_quality, train
from spindrift.llm.registry import ORACLES, QUERIES, query, table
from spindrift.llm.warc import through_archives

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""


@query("op1_embedding_near_dedup", EMBEDDING_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT doc_id, line, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = drop_common_lines(docs, LineStore.build(docs, min_docs=10))
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op5_warc", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = through_archives(table(spark, sf_dir, "pages")).where(F.col("gap").isNull())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; installed on every worker like any library."""
    return public_tokenizers.path(name)


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


@query("op8_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=5, threshold=0.8)


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, chain, carry=False)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


REPEATED_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(range(length(x) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN length(x) >= 2 * i + 100 THEN substr(x, 2 * i + 1, 100) END AS g FROM b),
f AS (SELECT g, min(doc_id) AS first FROM s WHERE g IS NOT NULL GROUP BY g),
r AS (SELECT s.doc_id, s.i, s.byte, coalesce(f.first < s.doc_id, false) AS starts FROM s LEFT JOIN f USING (g)),
c AS (SELECT doc_id, i, byte, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone - coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS step FROM c),
k AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (step = 1) AS n_spans,
             string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op11_suffix_array_dedup", REPEATED_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), size=50, with_text=False, with_digests=True)


def planted_period(doc_id, n: int) -> tuple[int, int] | None:
    """Where the contract of op12 plants a period in a text of ``n`` words, and which."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), least=24, power=3, plant=planted_period, with_text=False, with_digests=True)


@query("op13_fill_in_middle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_text=False, with_digests=True)


__all__ = ["ORACLES", "QUERIES"]
