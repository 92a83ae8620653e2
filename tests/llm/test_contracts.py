"""The opN queries on the smallest tables, samples at any size, and operators against plain code."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.llm import queries
from terrasift.llm.common import bounded_sample, sample_bound
from terrasift.llm.decontaminate import find_leaks, singular_vectors
from terrasift.llm.media import automaton, sniff
from terrasift.llm.near_duplicates import near_duplicates
from terrasift.llm.personal_data import FEATURES, GENERATORS, Judge, _trees, features, find_personal_data, mod97, proposals, redact
from terrasift.llm.url_filters import matches, mine_rules, tokens_of

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}
FOLDS = {"op1_language_model": (7, 2), "op4_toxicity": (5, 0), "op8_quality": (4, 2)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == k for c, k in COLUMNS[name].items())
    rows = got.collect()
    table = "pages" if name.startswith("op7") else "documents"
    key = "page_id" if name.startswith("op7") else "doc_id"
    assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())
    if name in FOLDS:
        folds, own = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == own) for r in rows)
    if "predicted" in kinds:
        cut = 0.5 if name.startswith("op4") else 0.7
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)


def test_samples_at_any_size(spark):
    for n in (10, 10**6, 5 * 10**10, 10**15):
        for limit in (1, 1500, 100_000):
            share = (sample_bound(limit, n) + 2**63 + 1) / 2**64
            assert share * n >= min(n, limit) * (1 - 1e-9) and share * n <= 12 * limit + 60 or share == 1
    ids = spark.range(40_000)
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("id")):
        df = ids.select(key.alias("k"), F.lit("text").alias("text"))
        one, again = (bounded_sample(df, 500, "k", "text") for _ in range(2))
        assert one.count() == 500 and sorted(one.collect(), key=str) == sorted(again.collect(), key=str)
    hot = ids.select(F.when(F.col("id") < 13_000, "hot").otherwise(F.col("id").cast("string")).alias("url"))
    assert 0.25 < bounded_sample(hot, 3000, "url").where("url = 'hot'").count() / 3000 < 0.4
    assert bounded_sample(ids.limit(20), 500, "id").count() == 20 and bounded_sample(ids.limit(0), 500, "id").count() == 0


IBAN = "DE89370400440532013000"
PLANTED = {
    "secret": "token = 3f9ab1{i:04d}cc81de77aa01", "account": "iban " + IBAN, "contact": "joe{i} [at] mail{i} [dot] com", "national": "phone: (415) 555-{i:04d}", "number": "ssn 123-45-{i:04d}",
}
PLAIN = ["order 123-45-{i:04d}", "item 4155550{i:04d}0", "ref: (415) 555-{i:04d}", "x{i:04d}99887766", "key = plainwordsonly"]


def test_every_generator_adds_and_redacts(spark):
    texts = [f"Words before {(list(PLANTED.values()) + PLAIN)[i % 10].format(i=i)} and after" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find_personal_data(df).collect()}
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    for i in range(400):
        kind = [*PLANTED, None, None, None, None, None][i % 10]
        if kind:
            assert kind in {s.kind for s in found[i]} and f"[{kind}]" in clean[i], texts[i]
        else:
            assert not found[i] and clean[i] == texts[i]
    long = "password=" + "aB3" * 400 + ".x9.y8 end"
    both = "secret = ab12cd34ef56ab12@mail.example.org tail"
    more = df.unionByName(spark.createDataFrame([(900, long), (901, both), (902, "1" * 500)], df.schema))
    out = {r.doc_id: r for r in redact(more).where("doc_id >= 900").collect()}
    assert out[900].text == "[secret] end" and out[901].text == "[secret][email] tail"
    rows = spark.createDataFrame([(IBAN,), ("DE89370400440532013001",), ("GB82 WEST 1234 5698 7654 32",)], "v string").select(mod97(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True, False, True]
    overlapping = spark.createDataFrame([("key=123456789012 and",)], "t string").select(proposals(F.col("t")).alias("p")).first().p
    assert {x.kind for x in overlapping} == {"secret", "number"}


def test_trees_as_sql_equal_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    texts = [(list(PLANTED.values()) + PLAIN)[i % 10].format(i=i) for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.explode(proposals(F.col("t"))).alias("p"))
    marked = rows.select((F.col("id") % 10 < 5).cast("double").alias("label"), F.struct(*[c.alias(k) for k, c in features(F.col("p")).items()]).alias("f")).select("label", "f.*")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(marked)
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(data)
    judge = Judge(_trees(model.toDebugString), [float(w) for w in model.treeWeights], 0.0)
    got = model.transform(data).select("prediction", judge.margin(F.struct(*FEATURES)).alias("margin")).collect()
    assert all((r.margin > 0) == (r.prediction == 1.0) for r in got) and len({r.prediction for r in got}) == 2 and len(GENERATORS) == 5


def test_url_rules_match_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = ["a.b.good.org", "x.bad.net", "deep.a.b.c.d.e.bad.net", "shop.good.org"]
    urls = [f"http://{hosts[i % 4]}/p{'abcde'[rng.integers(5)]}/q/r/s/t{'abc'[rng.integers(3)]}/u?k{'abcde'[i % 5]}=1&z={i}" for i in range(400)]
    block = [("bad.net" in u and "kb" in u) or "/tc/" in u for u in urls]
    df = spark.createDataFrame(list(zip(urls, block, strict=True)), "url string, block boolean")
    rules = mine_rules(df, least=5)
    rows = df.select("block", tokens_of(F.col("url")).alias("t"), matches(tokens_of(F.col("url")), rules).alias("hit")).collect()
    assert any("part4:tc" in r.t for r in rows) and any("label:d" in r.t for r in rows)
    for r in rows:
        assert r.hit == any(all(set(c.split("\0")) & set(r.t) for c in own) for own, _, _ in rules)
    for own, confidence, _ in rules:
        seen = [r.block for r in rows if all(set(c.split("\0")) & set(r.t) for c in own)]
        assert abs(np.mean(seen) - confidence) < 1e-9 and confidence >= 0.9
    assert all(r.hit for r in rows if "part4:tc" in r.t and r.block) and np.mean([r.hit == r.block for r in rows]) > 0.95
    hot = spark.createDataFrame([(f"http://h.org/{'/'.join(f'd{j}' for j in range(60))}", True)] * 300 + [(f"http://ok{i}.org/x{i}y/", False) for i in range(300)], "url string, block boolean")
    assert len(mine_rules(hot)) <= 70


def test_leaks_of_any_length_and_paraphrases(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("klmnopqrstuv"), 6))
    common = [word() for _ in range(400)]
    sizes = [10, 30, 100, 300, 800, 2000]
    items = [[word() if rng.random() < 0.5 else common[rng.integers(400)] for _ in range(n)] for n in sizes]
    docs = [[common[k] for k in rng.integers(0, 400, 200)] for _ in range(30)]
    want = set()
    for i, item in enumerate(items):
        docs[i] += item
        loose = [w for w in item if rng.random() > 0.15]
        for _ in range(len(item) // 10):
            loose.insert(int(rng.integers(len(loose))), word())
        docs[10 + i] = docs[10 + i][:50] + loose + docs[10 + i][50:]
        want |= {(i, i), (10 + i, i)}
    got = find_leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")).collect()
    found = {(r.doc_id, x.item_id) for r in got for x in r.leaks}
    assert found <= want and len(found) >= 0.9 * len(want) and {(i, i) for i in range(len(items))} <= found


def test_randomised_svd_finds_the_singular_vectors():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(500, 60)) @ np.diag(0.8 ** np.arange(60)) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    start = rng.normal(size=(60, 30))
    basis, value = singular_vectors(a.T @ (a @ start), start, 10)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(value[:5], s[:5], rtol=1e-2) and np.linalg.svd(basis[:, :5].T @ v[:8].T)[1].min() > 0.98


def test_near_duplicate_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for r in docs.where("text is not null").collect() if (w := r.text.split())}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for own in holders.values() if len(own) < 400 for a in own for b in own if a < b}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b])]
    assert len(links) > 100 and np.mean([got[a] == got[b] for a, b in links]) > 0.99


def test_hostile_media_take_linear_time():
    import time

    machine = automaton()
    began = time.time()
    for text in (b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"%PDF-1startxref"):
        assert sniff(text * 100_000, machine) == []
    assert time.time() - began < 20


def test_columns_in_any_case(spark):
    from terrasift.llm.quality import score_quality
    from terrasift.llm.url_filters import HostRule, filter_urls

    df = spark.createDataFrame([(1, "http://a.com/x", "h", 5, "S")], "page_id int, url string, Host string, _rule int, GIVEN string")
    got = filter_urls(df, [HostRule("com", "/", "block")])
    row = got.first()
    assert row._rule == 5 and row.GIVEN == "S" and row.host == "a.com" and row.rule == "com/"
    assert score_quality(spark.createDataFrame([("t", 1)], "text string, Score int"), None).columns == ["text", "score"]


def test_pipeline_stages_keep_columns_and_bear_anything(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, leaks string, row_key string, spans int"
    rows = [(1, "plain words that say nothing at all here", "en", "a", 3, 1, "l", "k", 2), (1, "plain words that say nothing at all here", "en", "b", 3, 1, "l", "k", 2), (None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 2, "m", "k", 3), (3, "mail a.b@c.org " * 3000, "en", "a", 4, 3, "n", "k", 4)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        if name != "mixing":
            assert got.columns == docs.columns and {r.leaks for r in got.collect()} <= {"l", "m", "n", None}, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.count() == 4 and len({tuple(r) for _ in range(2) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), FOLDER).where("doc_id = 1").collect()}) == 1
    assert re.fullmatch(r"(mail \[email\] ){3000}", corpus_pipeline.redact_personal_data(spark, docs, FOLDER).where("doc_id = 3").first().text)


def test_many_sure_tokens_make_no_power_set(spark):
    rng = np.random.default_rng(3)
    rows = [("http://h.example.org/p?" + "&".join(f"name{chr(97 + j // 26)}{chr(97 + j % 26)}=1" for j in range(40) if rng.random() < 0.9), True) for _ in range(600)]
    rows += [(f"http://h.example.org/{i}?{'u' if i % 2 else 'v'}=1&{'w' if i % 5 else 'x'}=2", bool(i % 2 and i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, block boolean")
    rules = mine_rules(df)
    assert {tuple(t) for t, _, _ in rules if any("name" in x for x in t)} == {(f"query:name{chr(97 + j // 26)}{chr(97 + j % 26)}",) for j in range(40)}
    assert ["query:u", "query:w"] in [sorted(t) for t, _, _ in rules]
    got = df.select("block", matches(tokens_of(F.col("url")), rules).alias("hit")).where("block <> hit").count()
    assert got == 0


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 15_000)).alias("text"))
    want = None
    for n in (1, 4, 9):
        got = sorted(tuple(r) for r in bounded_sample(df.repartition(n), 500, "doc_id", "text").collect())
        joined = df.join(spark.range(15_000).withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text")
        want = want or got
        assert got == want and sorted(tuple(r) for r in bounded_sample(joined, 500, "doc_id", "text").collect()) == want


def test_candidates_are_fitted_and_cut_on_all_rows(spark, monkeypatch):
    from terrasift.llm import personal_data

    texts = [f"call me at 555-{i % 900 + 100}-{i:04d} today" if i % 3 else f"order no. 555-{i % 900 + 100}-{i:04d} came" for i in range(4600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = []

    class Recorder(personal_data.GBTClassifier):
        def fit(self, data):
            fitted.append(data.agg(F.sum("n") if "n" in data.columns else F.count(F.lit(1))).first()[0])
            return super().fit(data)

    monkeypatch.setattr(personal_data, "GBTClassifier", Recorder)
    judge = personal_data.fit_candidates(df)
    assert judge is not None and fitted == [df.where("pmod(xxhash64(doc_id, text), 3) <> 0").count()]
