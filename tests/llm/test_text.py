"""Personal data, classifiers and the pipeline against plain Python and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import packing, pii, quality, toxicity
from spindrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"

# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda digits=digits: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda digits=digits: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def words_near(text, span, spans):
    s, e = span[0], span[2]
    found = []
    for m in re.finditer(r"[^\W_]+", text):
        a, b = m.span()
        low, high = max(0, s - pii.REACH), min(len(text), e + pii.REACH)
        whole = (b < s and (a > low or low == 0) and a >= low) or (a > e and (b < high or (high == len(text) and high - e < pii.REACH)) and b <= high)
        if whole and not any(x < b and a < y for x, _, y in spans):
            found.append((m.group().lower(), a, b))
    return found


def expected_spans(texts, support=3, remove=0.9, generalise=0.7):
    total = len(texts)
    vocabulary = collections.Counter(w for t in texts for w in set(re.split(r"[\W_]+", t.lower())))
    entity_docs, both, kinds = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    named = {}
    for t in texts:
        spans = base(t)
        value = {s: f"{s[1]}:" + (re.sub("[^0-9]", "", t[s[0] : s[2]]) if s[1] in (2, 3) else t[s[0] : s[2]].lower()) for s in spans}
        named[t] = (spans, value)
        entity_docs.update(set(value.values()))
        pairs = {(value[s], w) for s in spans for w, _, _ in words_near(t, s, spans)}
        both.update(pairs)
        for p in pairs:
            kinds[p].add(t)
    action = {}
    for (e, w), n in both.items():
        information = -math.log(entity_docs[e] / total)
        if len(kinds[e, w]) >= support and information > 0:
            share = math.log(n * total / (vocabulary[w] * entity_docs[e])) / information
            if share >= generalise:
                action[e, w] = 4 if share >= remove else 5
    out = {}
    for t in texts:
        spans, value = named[t]
        extra = {}
        for s in spans:
            for w, a, b in words_near(t, s, spans):
                if (value[s], w) in action:
                    extra[a, b] = min(extra.get((a, b), 9), action[value[s], w])
        out[t] = sorted([*spans, *[(a, r, b) for (a, b), r in extra.items()]])
    return out


def pii_texts():
    rng = random.Random(4)
    common = [f"word{i}" for i in range(60)]
    texts = ["", "plain text", "a@b", "a@b.c_d@e.f. x@y.z@w.q", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 1234", "+1 (555) 123-4567) +49 30 12 +1" + "(" * 500, "é漢🙂 me@x.org 🙂 10.0.0.1", "9" * 3000, "a." * 2000 + "@x.y", "1 " * 3000, "+" * 300 + "1234567890"]
    for _ in range(40):
        words = rng.choices(common, k=rng.randint(5, 40))
        who = rng.randrange(6)
        words.insert(rng.randrange(len(words)), f"Nick{who} project{who} Person{who}@mail.example.org room{who % 2}")
        texts.append(" ".join(words))
    texts += ["nick4 alone", "some nick4 here", "nick4 there", "nick3 without the address", " ".join(common), *texts[-3:]]
    return texts


def test_spans_and_disclosing_terms_equal_plain_python(spark):
    texts = pii_texts()
    expected = expected_spans(texts)
    assert {r for s in expected.values() for _, r, _ in s} == {0, 1, 2, 3, 4, 5}
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS + ", base string, row int").repartition(4)
    for r in pii.find_personal_data(frame).collect():
        assert r.text == texts[r.row.doc_id]
        assert [tuple(s) for s in r.base] == base(r.text)
        assert [tuple(s) for s in r.spans] == expected[r.text]


def test_personal_data_of_nulls_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a@b.c"), (1, None), (1, None), (2, "")], DOCS)
    got = pii.find_personal_data(frame).select("row.doc_id", F.size("spans").alias("n")).collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("None", 1)]
    assert pii.find_personal_data(frame.limit(0)).collect() == []


def test_sanitised_text(spark):
    rows = [("ab me@x.y cd 77 Ef", [(3, 0, 9), (10, 4, 12), (13, 5, 15), (16, 5, 18)]), ("漢 1.2.3.4", [(2, 1, 9), (4, 2, 9)]), ("none", [])]
    frame = spark.createDataFrame(rows, "text string, spans array<struct<start:long,rank:int,end:long>>").withColumn("row", F.struct("text"))
    got = {r.row.text: r.clean_text for r in pii.sanitise(frame).collect()}
    assert got == {"ab me@x.y cd 77 Ef": "ab [email]  [number] [name]", "漢 1.2.3.4": "漢 [ip]", "none": "none"}


def test_the_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "a@b.c")], DOCS)
    plan = pii.sanitise(pii.find_personal_data(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_base_spans_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_pii"](spark, SF).collect():
        spans = base(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


# ---- classifiers

EDGES = [(900, None), (901, ""), (902, " \n"), (None, "some words here"), (903, "long " * 40_000), (901, ""), (904, "漢字 🙂")]


def test_quality_of_held_out_rows_and_odd_texts(spark):
    scored = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scored)
    assert np.mean([scored[i].predicted == labels[i] for i in held]) > 0.97
    assert len(scored) == 1000


def test_quality_edges(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30))) for i in range(0, 200, 2)]
    bad = [(i, " ".join(rng.choices(["XX!!", "YY!!", "ZZ!!"], k=30))) for i in range(1, 200, 2)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in good + bad + EDGES], DOCS + ", score double")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)] + [(None, 1), (5, None), (7, 9), (0, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    again = quality.train(docs.repartition(3), labels.repartition(3), F.lit(True))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(good) + len(bad) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert quality.train(docs, labels.limit(0), F.lit(True))[1] == 0.0
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id").where("lang = 'en'")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score_toxicity(docs, chain).join(labels, "doc_id").where("doc_id % 2 = 1").groupBy("toxic").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
    shares = {r.toxic: r.share for r in got}
    assert shares[1] > 0.9 and shares[0] < 0.01


def test_chain_uses_earlier_categories_out_of_fold():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(600)]
    first = np.array([float(3 in r) for r in rows])
    chain = toxicity.fit_chain(rows, np.column_stack([first, first]), np.arange(600) % toxicity.FOLDS)
    assert [m.dense for m in chain] == [0, 1] and chain[1].weights[toxicity.BUCKETS] > 0.1


def test_toxicity_edges(spark):
    data = [(i, f"fine words number {i} and so on") for i in range(60)] + [(i, f"you idiot scum number {i}") for i in range(60, 100)] + EDGES
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], DOCS + ", p_toxic double")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(data) and all(r.rejected == (60 <= r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id < 900)
    assert not any(r.rejected for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels.limit(0))).collect())
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train(docs, labels.limit(0))).collect() == []


# ---- pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = {i: " ".join(rng.choices(words, k=80)) for i in range(60)}
    toxic = {i: f"{' '.join(rng.choices(words, k=30))} idiot scum moron trash" for i in range(60, 100)}
    near = {100 + i: text[i] + " tail" for i in range(5)}
    shared = {110 + i: f"Common Line\n{' '.join(rng.choices(words, k=40))}" for i in range(12)}
    private = {130: f"write to me@corp.example about {' '.join(rng.choices(words, k=40))}"}
    odd = {140: None, 141: "", 142: "Common Line"}
    data = {**text, **toxic, **near, **shared, **private, **odd}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data.items()], DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in data if i < 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["toxicity"]) == set(data) - set(toxic)
    assert set(seen["line_dedup"]) == set(seen["toxicity"])
    assert all(seen["line_dedup"][i].text == t.split("\n")[1] for i, t in shared.items())
    assert seen["line_dedup"][142].text == "" and seen["line_dedup"][5].text == text[5]
    assert set(seen["minhash_near_dedup"]) == set(seen["line_dedup"]) - set(near)
    assert seen["pii"][130].text == private[130].replace("me@corp.example", "[email]") and seen["pii"][7].text == text[7]
    assert all(r.n_chars == len(r.text) for r in seen["pii"].values() if r.doc_id != 140)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])


def test_every_query_of_the_entry_is_there():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op2_exact_dedup", "op4_line_dedup", "op5_warc"])
def test_queries_equal_sql(spark, name):
    from oracle_check import compare, duck

    from spindrift.llm.queries import ORACLES

    sf = "/root/testdata/sf0.001"
    ok, note = compare(spark, duck(sf), QUERIES[name], ORACLES[name], sf)
    assert ok, note


def test_terms_disclose_at_any_distance(spark):
    filler = " ".join(f"common{i}" for i in range(60))
    texts = [f"Dear Zoltan{i // 4}, {filler} zoltan{i // 4}: {filler} z{i // 4}@mail.example.org and 1ZOLTAN{i // 4} no {i}" for i in range(8)] + [filler] * 8
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in pii.find_personal_data(frame).collect():
        found = [(r.text[a:b], k) for a, k, b in r.spans if k > 3]
        who = r.row.doc_id // 4
        assert found == ([(f"Zoltan{who}", 4), (f"zoltan{who}", 4), (f"1ZOLTAN{who}", 4)] if who < 2 else [])


def test_words_that_spans_cut_are_no_terms(spark):
    text = "tel+49 170 1234567 é.mail@x.com émail@y.com 1.2.3.4abc a\x00b 漢 x@y.z"
    frame = spark.createDataFrame([(text,)], "text string")
    words = F.regexp_extract_all(pii._outside(F.col("text"), pii.base_spans(F.col("text"))), F.lit(pii.FREE_WORD), F.lit(0))
    spans = base(text)
    expected = [m.group() for m in re.finditer(r"[^\W_]+", text) if not any(x < m.end() and m.start() < y for x, _, y in spans)]
    assert frame.select(words).first()[0] == expected and {"tel", "é", "a", "b", "漢"} == set(expected)


def test_the_pipeline_keeps_the_tokens_of_its_sequences(spark):
    texts = ["one two three " * n for n in (1, 40, 900, 2000)] + [""]
    packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(list(enumerate(texts)), DOCS), "").cache()
    pieces = packed.collect()
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in pieces)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    per_token = {len(bytes(r.ids)) / r.length for r in pieces}
    assert len(per_token) == 1
    size = int(per_token.pop())
    for r in pieces:
        assert whole[r.sequence_id][r.offset * size : (r.offset + r.length) * size] == bytes(r.ids)
    packed.unpersist()
