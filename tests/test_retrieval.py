import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spindrift.retrieval import text, vector
from spindrift.streaming import index_refresh

DOCS = [
    (1, "rules", "a", "Age limit: guests must be 21."),
    (2, "rules", "b", "The slot rules, the slot rules! slot"),
    (3, "hours", "c", "Open hours of the casino floor"),
    (4, "hours", "d", ""),
    (5, "misc", "e", "the the the the"),
]
SCHEMA = "policy_id long, category string, title string, content string"


def brute_force(docs, query, k, keep=lambda d: True):
    words = {d[0]: [w for w in re.split(r"[^a-z0-9]+", d[3].lower()) if w] for d in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    scored = []
    for d in docs:
        if not keep(d):
            continue
        total, hit = 0.0, False
        for term in {w for w in re.split(r"[^a-z0-9]+", query.lower()) if w}:
            df = sum(term in w for w in words.values())
            tf = words[d[0]].count(term)
            if tf:
                hit = True
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[d[0]]) / avg))
        if hit:
            scored.append((round(total, 6), d[0]))
    return [(d, s) for s, d in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_bm25_equals_brute_force_on_every_path(spark, monkeypatch):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 30
    docs = DOCS + [(i, "misc", "t", " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 40)))) for i in range(10, 60)]
    asked = [(1, "the slot rules"), (2, "casino hours w3 w4 w5 the"), (3, "nothing matches zzz")]
    df = spark.createDataFrame(docs, SCHEMA)
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    plain = text.build_index(df)
    for index in (plain, text.store_index(plain, 4)):
        for limit in (text.BLOCK_TERMS, 3):
            monkeypatch.setattr(text, "BLOCK_TERMS", limit)
            got = answers(text.search(index, queries, k=5))
            assert got == {q: brute_force(docs, t, 5) for q, t in asked if brute_force(docs, t, 5)}
            narrowed = answers(text.search(index, queries, k=3, filters={"category": "rules"}))
            expected = {q: brute_force(docs, t, 3, lambda d: d[1] == "rules") for q, t in asked}
            assert narrowed == {q: hits for q, hits in expected.items() if hits}
    titled = text.search(plain, queries, k=1, columns=("title",))
    assert {r["title"] for r in titled.where("query_id = 1").collect()} == {"b"}


def test_stored_index_scores_without_moving_postings(spark):
    index = text.store_index(text.build_index(spark.createDataFrame(DOCS, SCHEMA)), 4)
    queries = spark.createDataFrame([(1, "the slot")], "query_id long, query_text string")
    scored = text.scores(index, text.query_terms(queries))
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    executed = scored._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 4 out of 4" in executed or "Bucketed: true" in executed, plan
    assert "hashpartitioning(query_id" not in executed


def test_vector_search_in_one_block_and_in_several(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 8))
    vectors[7] = vectors[3]  # equal scores: the smaller id wins
    asked = rng.normal(size=(9, 8))
    asked[0] = vectors[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    similarity = np.round(unit(asked) @ unit(vectors).T, 6)
    expected = {(q, int(v)) for q in range(9) for v in np.lexsort((np.arange(200), -similarity[q]))[:5]}
    for block, chunk in ((100, 1000), (4, 60)):
        monkeypatch.setattr(vector, "VECTOR_CHUNK", chunk)
        got = vector.search(df, queries, 5, block).collect()
        assert {(r["query_id"], r["vec_id"]) for r in got} == expected and len(got) == 45
    first = vector.search(df, queries, 2).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in first] == [3, 7]


def test_refresh_equals_batch_rebuild(spark, tmp_path):
    source, index_dir, progress = (str(tmp_path / n) for n in ("in", "index", "progress"))
    schema = spark.createDataFrame(DOCS, SCHEMA).schema

    def drop(docs):
        spark.createDataFrame(docs, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        index_refresh.start(spark, source, schema, index_dir, progress).awaitTermination()

    drop(DOCS[:3])
    drop([(2, "rules", "b2", "completely new words"), DOCS[3], DOCS[4]])
    drop([DOCS[0]])  # an unchanged document may come again
    final = [DOCS[0], (2, "rules", "b2", "completely new words"), *DOCS[2:]]
    rebuilt = text.build_index(spark.createDataFrame(final, SCHEMA))
    for index in (index_refresh.read_index(spark, index_dir), index_refresh.compact(spark, index_dir, str(tmp_path / "c"))):
        for name in ("postings", "documents"):
            ours, theirs = getattr(index, name), getattr(rebuilt, name)
            columns = sorted(theirs.columns)
            a = sorted(tuple(r) for r in ours.select(columns).collect())
            assert a == sorted(tuple(r) for r in theirs.select(columns).collect())


def test_replayed_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame(DOCS, SCHEMA)
    path = str(tmp_path / "index")
    index_refresh.apply_batch(batch, 0, path)
    before = index_refresh.read_index(spark, path).postings.count()
    index_refresh.apply_batch(batch, 0, path)
    assert index_refresh.read_index(spark, path).postings.count() == before


def test_a_late_older_version_loses_also_after_compaction(spark, tmp_path):
    columns = SCHEMA + ", version long"
    path, folded = str(tmp_path / "index"), str(tmp_path / "folded")
    for batch, (version, words) in enumerate([(1, "first"), (3, "third one"), (2, "second late")]):
        index_refresh.apply_batch(spark.createDataFrame([(1, "c", "t", words, version)], columns), batch, path, order="version")
    index_refresh.compact(spark, path, folded)
    index_refresh.apply_batch(spark.createDataFrame([(1, "c", "t", "zero", 0)], columns), 0, folded, order="version")
    for where in (path, folded):
        assert sorted(r["term"] for r in index_refresh.read_index(spark, where).postings.collect()) == ["one", "third"]


def test_unchanged_texts_write_no_posting_and_withdrawn_ones_are_not_found(spark, tmp_path):
    path, folded = str(tmp_path / "index"), str(tmp_path / "folded")
    columns = SCHEMA + ", withdrawn boolean"
    first = [(1, "rules", "a", "alpha beta"), (2, "rules", "b", "gamma"), (3, "house", "c", None)]
    index_refresh.apply_batch(spark.createDataFrame(first, SCHEMA), 0, path)
    again = [(1, "rules", "new title", "alpha beta"), (3, "house", "c", "")]
    for _ in range(2):  # a replay compares with the batches before it
        index_refresh.apply_batch(spark.createDataFrame(again, SCHEMA), 1, path)
    assert spark.read.parquet(f"{path}/postings").where("batch = 1").count() == 0
    index_refresh.apply_batch(spark.createDataFrame([(2, "rules", "b", "gamma", True), (1, "rules", "a", "alpha delta", None)], columns), 2, path)
    index_refresh.compact(spark, path, folded)
    for where in (path, folded):
        index = index_refresh.read_index(spark, where)
        assert sorted((r["doc_id"], r["term"]) for r in index.postings.collect()) == [(1, "alpha"), (1, "delta")]
        assert sorted((r["doc_id"], r["doc_len"]) for r in index.documents.collect()) == [(1, 2), (3, 0)]
        index_refresh.apply_batch(spark.createDataFrame([(2, "rules", "b", "gamma"), (1, "rules", "a", "alpha delta")], SCHEMA), 3, where)
        assert sorted((r["doc_id"], r["term"]) for r in index_refresh.read_index(spark, where).postings.collect()) == [(1, "alpha"), (1, "delta"), (2, "gamma")]
    done = {r["batch"]: (r["changed"], r["unchanged"], r["withdrawn"]) for r in index_refresh.lag(spark, path).collect()}
    assert done == {0: (3, 0, 0), 1: (0, 2, 0), 2: (1, 0, 1), 3: (1, 1, 0)}


def test_lag_and_progress_of_a_stream_are_tables(spark, tmp_path):
    source, index_dir = str(tmp_path / "in"), str(tmp_path / "index")
    frame = spark.createDataFrame(DOCS, SCHEMA)
    frame.coalesce(1).write.parquet(source)
    listener = index_refresh.Progress()
    spark.streams.addListener(listener)
    try:
        query = index_refresh.start(spark, source, frame.schema, index_dir, str(tmp_path / "progress"))
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seen = listener.table(spark).collect()
    finally:
        spark.streams.removeListener(listener)
    behind = index_refresh.lag(spark, index_dir).collect()
    assert [r["changed"] for r in behind] == [len(DOCS)] and behind[0]["lag_seconds"] > 0
    assert sum(r["rows"] for r in seen) in (0, len(DOCS))  # events come from another thread


def test_a_task_holds_few_texts_whatever_their_number(spark, monkeypatch):
    """Tasks and buckets follow the characters; without texts there is still one."""
    monkeypatch.setattr(text, "CHARS_PER_TASK", 1000)
    docs = spark.range(200).select(F.col("id").alias("policy_id"), F.concat(F.lit("word " * 19), F.col("id").cast("string")).alias("content"), F.lit("c").alias("category"), F.lit("t").alias("title"))
    rows = text.postings(docs)
    assert rows.rdd.getNumPartitions() >= 19
    assert rows.where("term = 'word'").agg(F.sum("tf"), F.count("*")).first() == (200 * 19, 200)
    assert text.postings(docs.where("false")).count() == 0
    stored = text.store_index(text.build_index(docs))
    assert stored.postings.agg(F.sum("tf")).first()[0] == 200 * 20
    files = stored.postings.groupBy(F.input_file_name()).agg(F.count_distinct("doc_id").alias("n"))
    assert files.agg(F.max("n")).first()[0] <= 30
