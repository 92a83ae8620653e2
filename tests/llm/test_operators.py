"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from terrasift.llm import language_model as lm
from terrasift.llm import media, near_duplicates, substrings
from terrasift.llm import toxicity as tox
from terrasift.llm.decontaminate import common_subsequence, find_leaks
from terrasift.llm.mixing import mix_sources, source_targets
from terrasift.llm.personal_data import base_spans
from terrasift.llm.quality import fit_pu, scores
from terrasift.llm.url_filters import HostRule, filter_urls, mine_rules

RNG = np.random.default_rng(11)
VOCABULARY = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return [VOCABULARY[min(int(rng.pareto(0.9) * 3), 399)] for _ in range(n)]


def corpus():
    rng = np.random.default_rng(5)
    docs = [prose(int(rng.integers(5, 300)), rng) for _ in range(60)]
    shared = prose(50, rng)
    for i in range(0, 12, 2):
        docs[i] = docs[i][:20] + shared + docs[i][20:]
    docs += [list(docs[3]), list(docs[3]), docs[4] + prose(3, rng)]
    near = prose(200, rng)
    for i in range(8):
        other = list(near)
        other[20 * i + 5] = f"edit{i}"
        docs.append(other)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in corpus()], "doc_id long, text string, source string")


@pytest.mark.parametrize("many", [2048, 1])
def test_substrings_match_brute_force(docs, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, length=35).collect()}
    words = {i: t.split() for i, t in corpus()}
    count = collections.Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if count[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        assert got[i].kept == " ".join(x for x, g in zip(w, gone, strict=True) if not g) and got[i].n_removed == sum(gone)
    assert sum(r.n_removed for r in got.values()) > 500


def test_automaton_counts():
    texts = [np.array([1, 2, 3, 1, 2, 3]), np.array([2, 3, 1, 9])]
    got = substrings.window_counts(texts, [1, 2], 3)
    assert [g.tolist() for g in got] == [[2, 3, 1, 2], [3, 2]]


def test_near_duplicates_match_brute_force(docs):
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in corpus() for w in [t.split()]}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert got == root


@pytest.mark.parametrize("side", [1024, 16])
def test_hot_bucket_with_outsiders_and_a_chain(spark, monkeypatch, side):
    monkeypatch.setattr(near_duplicates, "SIDE", side)
    monkeypatch.setattr(near_duplicates, "bands", lambda signed: signed.selectExpr("cast(kind as bigint) as bucket", "key", "kind"))
    rng = np.random.default_rng(17)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    hot, pair, chain = fresh(100), fresh(100), fresh(260)
    texts = [hot[: i % 90] + [f"edit{i}"] + hot[i % 90 + 1 :] for i in range(90)]
    texts += [pair, [*pair[:-1], "last"]] + [chain[8 * i : 8 * i + 100] for i in range(20)] + [fresh(60) for _ in range(10)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {i: 0 if i < 90 else 90 if i < 92 else 92 if i < 112 else i for i in range(122)}


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.random(400) + 0.5
    a, b = np.arange(0, 340), np.arange(40, 400)
    w2 = w.copy()
    w2[100:150] *= 1.7
    both = near_duplicates.weighted_jaccard((np.sort(h[a]), w[a][np.argsort(h[a])]), (np.sort(h[b]), w2[b][np.argsort(h[b])]))
    hits = []
    for s in range(300):
        xa, sa = near_duplicates.consistent_samples(h[a], w[a], s)
        xb, sb = near_duplicates.consistent_samples(h[b], w2[b], s)
        hits.append(sa[xa.argmin()] == sb[xb.argmin()])
    assert abs(np.mean(hits) - both) < 0.08


def test_language_model_base_and_order(docs):
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    words = {i: t.lower().split() for i, t in corpus()}
    count = collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*w, "<end>"])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w, "<end>"])
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_known == sum(count[x] > 0 for x in [*w, "<end>"])
        assert got[i].train_tokens == n and got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_predictions_sum_to_one(spark, docs):
    table = lm.count_contexts(docs).toArrow()
    model = lm.fit(spark.createDataFrame(table), sweeps=2, burn_in=0)
    order = np.argsort(table.column("word").to_numpy().view(np.uint64))
    batch = table.take(order).combine_chunks().to_batches()[0]
    k = lm.known(batch, model, [lm._stirling(d) for d in model.setting.discount])
    down, none = lm.unseen(model)
    for context in np.unique(k.pair % lm.CONTEXTS)[:5]:
        at = np.arange(len(k.word))
        total = lm.chances(k, at, np.full(len(at), context), down).sum() + none[context]
        assert abs(total - 1) < 1e-6


def test_seating_follows_its_law():
    d, mass, c, n = 0.6, 1.3, 6, 40_000
    s = lm._stirling(d)
    t = lm.sample_tables(np.full(n, c), np.full(n, mass), d, s, np.arange(n, dtype=np.uint64) * np.uint64(7919), 1)
    p = np.exp(s[c, 1 : c + 1]) * mass ** np.arange(1, c + 1)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - p / p.sum()).max() < 0.012
    # beyond 64 customers: the limit law against the exact one
    for c, mass in ((100, 1.3), (300, 30.0), (300, 300.0), (1500, 300.0)):
        exact, t = np.full(c + 1, -np.inf), np.arange(c + 1)
        exact[1] = 0.0
        for k in range(1, c):
            stay = np.where(k - d * t > 0, exact + np.log(np.maximum(k - d * t, 1e-12)), -np.inf)
            exact = np.logaddexp(np.r_[-np.inf, exact[:-1]], stay)
        p = np.exp(exact + t * np.log(mass) - (exact + t * np.log(mass)).max())
        p /= p.sum()
        mean, spread = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        drawn = lm.sample_tables(np.full(n, c), np.full(n, mass), d, s, np.arange(n, dtype=np.uint64) * np.uint64(104729), 4)
        assert abs(drawn.mean() / mean - 1) < 0.03 and abs(drawn.std() / spread - 1) < 0.05
    big = lm.sample_tables(np.array([1, 70, 10**9]), np.array([0.1, 1.0, 50.0]), d, s, np.arange(3, dtype=np.uint64), 1)
    assert big[0] == 1 and 1 <= big[1] <= 70 and 50 < big[2] < 10**7


def test_mixing(spark, docs):
    got = mix_sources(docs).collect()
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    total = sum(size.values())
    left, open_, want = 1.5 * total, dict(zip(sorted(size), itertools.cycle((5, 2, 1)), strict=False)), {}
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if 2 * size[s] <= level * open_[s]]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    longest = max(r["size"] for r in got)
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= longest
    assert sum(taken.values()) == round(1.5 * total)
    null = source_targets(spark.createDataFrame([("b", 10), (None, 10), ("a", 10)], "source string, source_size long"))
    assert [r.weight for r in null.orderBy("weight").collect()] == [1.0, 2.0, 5.0] and null.where("source is null").first().weight == 1.0


def test_toxicity_learns_words():
    rng = np.random.default_rng(3)
    label = (np.arange(600) % 4 == 0).astype(int)
    texts = [" ".join(prose(int(rng.integers(5, 80)), rng) + (["vilewordone", "fine"] if y else ["fine"])) for y in label]
    ids = [tox.word_ids(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    emb, filters, bias, out, c = tox.fit_cnn(ids[:400], label[:400])
    tables = [[emb @ f[j] for j in range(len(f))] for f in filters]
    top = np.array([tox.pooled(tables, x, np.zeros(len(x), int), 1)[0][0] for x in ids[400:]])
    margin = np.maximum(top + bias, 0) @ out + c
    assert margin[label[400:] == 1].min() > margin[label[400:] == 0].max()


def test_pu_learning_separates_without_negatives():
    rng = np.random.default_rng(4)
    good = lambda n: rng.normal(0, 1, (n, 10)).astype(np.float32)
    bad = lambda n: (rng.normal(0, 1, (n, 10)) + 2.0 * (np.arange(10) < 3)).astype(np.float32)
    model = fit_pu(good(800), np.vstack([good(800), bad(200)]))
    assert 0.65 < model.prior < 0.95
    assert scores(model, good(500)).mean() > scores(model, bad(500)).mean() + 0.2


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        odd = sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and odd % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_formats_match_the_plain_patterns(spark):
    from pyspark.sql import functions as F

    texts = ["", "ü a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111  1111", "+1 (743) 555-3824 +49.30.123456 +1 2", "a@b..c a@b.c. %+-@x.y.z", "+12345678901234567 1234567890123456 4222222222222"]
    texts += ["".join(RNG.choice(list("0123.-@+ (a)"), 400)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", *[F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])).alias(k) for k, c in base_spans(F.col("text")).items()]).collect()
    for r in rows:
        for kind, pattern in PATTERNS.items():
            want = [f"{m.start()}:{m.end()}" for m in re.finditer(pattern, texts[r.doc_id]) if passes(kind, m.group())]
            assert r[kind] == want, (kind, texts[r.doc_id])


def test_mined_rules(spark):
    rows = [(f"http://h{i % 7}.example.org/{'ads' if i % 3 == 0 else 'news'}/{i}", i % 3 == 0) for i in range(90)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    rules = mine_rules(labelled)
    assert rules and any(t == ["part0:ads"] for t, _, _ in rules) and not any("part0:news" in t and len(t) == 1 for t, _, _ in rules)
    df = spark.createDataFrame([(1, "https://new.example.org/ads/7"), (2, "https://new.example.org/news/7")], "page_id int, url string")
    got = {r.page_id: r.verdict for r in filter_urls(df, [HostRule("zz", "/", "allow")], labelled).collect()}
    assert got == {1: "block", 2: "allow"}


def test_leaks_and_paraphrases(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("klmnopqrst"), 7))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = [(i, " ".join(prose(150, rng))) for i in range(30)]
    docs[3] = (3, docs[3][1] + " " + items[4][1].upper() + ", " + docs[5][1])
    changed = items[7][1].split()
    changed[3:5] = ["other", "extra", "words"]
    changed[12] = "swapped"
    docs[8] = (8, " ".join(changed) + " " + docs[8][1])
    docs[9] = (9, docs[9][1] + " " + " ".join(items[2][1].split()[:10]))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == {(3, 4), (8, 7)}
    a, b = rng.integers(0, 6, 40).astype(np.uint64), rng.integers(0, 6, 60).astype(np.uint64)
    row = [0] * 61
    for x in a:
        row = list(itertools.accumulate(range(1, 61), lambda left, j, x=x, row=row: row[j - 1] + 1 if b[j - 1] == x else max(left, row[j]), initial=0))
    assert common_subsequence(a, b) == row[-1]


def test_leaks_of_common_words_and_of_long_items(spark):
    rng = np.random.default_rng(13)
    common = ["".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(300)]
    filler = lambda n: rng.choice(common, n).tolist()
    items = [[f"rare{i}x{j}" for j in range(6)] + rng.choice(common, 24, replace=False).tolist() for i in range(8)]
    items += [[f"long{i}x{j}" for j in range(300)] for i in range(2)]
    docs = [filler(300) for _ in range(60)]
    docs[7] = docs[7] + ["altered"] * 6 + items[2][6:] + filler(50)  # the rare words are lost
    loose = [x for j, w in enumerate(items[9]) if j % 3 for x in ([w, "between"] if j % 2 else [w])]
    docs[11] = filler(40) + loose + docs[11]
    got = find_leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string")).collect()
    assert {(r.doc_id, x.item_id, x.overlap) for r in got for x in r.leaks} == {(7, 2, 24), (11, 9, 200)}


def test_media_round_trip_and_sniffing(spark):
    payload = bytes(range(256)) * 4
    stored = media.wav(payload)
    assert media.wav_samples(stored) == payload
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02" + b"\x01\x00\x00" + b"\x3b"
    import gzip

    packed = gzip.compress(b"hello", mtime=0)
    whole = b"BM junk" + png + b"between" + packed + gif + stored + png[:-5]
    df = spark.createDataFrame([(1, bytearray(whole), "image/png"), (2, bytearray(png), "image/gif"), (3, None, None), (4, bytearray(b""), "x/y")], "id int, content binary, kind string")
    got = {r.id: r for r in media.sniff_media(df, "content", "kind").collect()}
    assert [p.type for p in got[1].media_parts] == ["image/png", "application/gzip", "image/gif", "audio/wav"]
    assert [bytes(p.content) for p in got[1].media_parts] == [png, packed, gif, stored] and got[1].media_type == "image/png" and not got[1].type_corrected
    assert got[2].media_type == "image/png" and got[2].type_corrected and got[3].media_parts == [] and got[4].media_type == "x/y"
    row = media.text_media(spark.createDataFrame([(1, "é" * 32), (2, "x" * 65)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert (row[0].n_bytes, row[0].payload_bytes, row[1].payload_bytes) == (64, 64, 128)
    assert row[0].payload_sha256 == hashlib.sha256(("é" * 32).encode()).hexdigest() and row[1].tail_crc32 == zlib.crc32(b"x" + bytes(63))


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    assert corpus_pipeline.run(spark, folder).count() == n


def test_blocks_of_texts_compare_as_single_pairs():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    known = {}
    for i in range(30):
        at = np.sort(rng.choice(len(pool), rng.integers(0, 120), replace=False))
        known[bytes([i])] = (pool[at], rng.choice([1.0, 1.5, 2.25], len(at)) * (1 + (pool[at] % np.uint64(7)) / 10))
    keys = list(known)
    left, right = keys[:18], keys[12:]
    low = near_duplicates.common_weights([known[k] for k in left], [known[k] for k in right])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            own, theirs = (dict(zip(x[0].tolist(), x[1].tolist(), strict=True)) for x in (known[a], known[b]))
            assert math.isclose(low[i, j], sum(min(w, theirs[h]) for h, w in own.items() if h in theirs), abs_tol=1e-9)
    hits = rng.random((len(left), len(right))) < 0.9
    for some in (hits, hits & (np.arange(hits.size).reshape(hits.shape) % 11 == 0)):
        got = near_duplicates.similar(right, left, some, known, 0.05)
        assert got and set(got) == {(left[i], right[j]) for i, j in zip(*np.nonzero(some), strict=True) if near_duplicates.weighted_jaccard(known[left[i]], known[right[j]]) >= 0.05}
    assert near_duplicates.similar(right, left, hits & False, known, 0.05) == []
