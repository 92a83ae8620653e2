"""The language model's contexts are whole words, however many there are."""

import zlib
from pathlib import Path

import numpy as np

from terrasift import storage
from terrasift.llm import word_contexts as wc
from terrasift.llm.common import bucket_of
from terrasift.llm.seating import _stirling


def test_words_of_one_ending_are_different_contexts(spark):
    # all contexts end in "zabc" and have five letters: only the whole word says what follows
    first, then = [f"{x}zabc" for x in "mnopqrst"], [f"next{i}" for i in range(8)]
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [(i, f"{first[i % 8]} {then[i % 8]}") for i in range(500) if i not in held]
    texts += [(i, f"{first[k % 8]} {then[k // 8 % 8]}") for k, i in enumerate(held)]
    got = {r.doc_id: r.score for r in wc.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    right = [got[i] for k, i in enumerate(held) if k % 8 == k // 8 % 8]
    wrong = [got[i] for k, i in enumerate(held) if k % 8 != k // 8 % 8]
    assert right and wrong and min(right) > max(wrong) + 1


def test_chances_of_all_words_sum_to_one_after_each_word(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(words[min(int(rng.pareto(1) * 2), 11)] for _ in range(60)) + " " + " ".join(words)) for i in range(20)]
    # a held-out text with every word after every word, and an unknown one after each
    texts.append((1000, " ".join(f"{a} {b}" for a in words for b in [*words, "unknown"])))
    texts += [(1001 + i, a) for i, a in enumerate(words)]
    rows = spark.createDataFrame(texts, "id long, text string").selectExpr("text", "id >= 1000 as held")
    state = wc.stored(wc.counted(rows, 1))
    model, replies, _ = wc.fit(state, 1, 3, 0)
    assert all(h.strength[1] > 0 for h in model.history) and model.words == 13
    d = wc.unpack_bucket(wc.with_replies(state, {s: r for s, r in enumerate(replies) if s}).toArrow())
    p = wc.pair_chances(d, model, [_stirling(x) for x in model.discount])
    for u in range(len(d.asked)):
        own = d.at == u
        if own.sum() == 14:  # 12 words, the end, the unknown one
            assert abs(p[own].sum() - 1) < 1e-9
    assert (np.bincount(d.at) == 14).sum() == 12


def test_buckets_blocks_and_broadcast_pairs_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{int(rng.pareto(1) * 5)}" for _ in range(int(rng.integers(0, 200))))) for i in range(80)] + [(None, None), (None, ""), (3, "w1 w2")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    one = sorted(wc.score_texts(df).collect(), key=key)
    monkeypatch.setattr(wc, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(wc, "HOT_PAIRS", 20)
    monkeypatch.setattr(wc, "BLOCK", 500)
    other = sorted(wc.score_texts(df.repartition(3)).collect(), key=key)
    assert len(one) == len(other) == 83
    for a, b in zip(one, other, strict=True):
        assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-4 and abs(a.base_score - b.base_score) < 1e-9
    assert sum(r.held_out for r in one) == df.where(bucket_of("doc_id", 7) == 2).count()


def test_parts_of_the_texts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(f"w{int(rng.pareto(1) * 5)}" for _ in range(int(rng.integers(0, 90))))) for i in range(60)] + [(None, None), (None, ""), (3, "w1 w2")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    monkeypatch.setattr(wc, "HOT_PAIRS", 20)
    got = []
    for parts in (1, 3):
        monkeypatch.setattr(wc, "SCORE_PARTS", parts)
        got.append(sorted(wc.score_texts(df).collect(), key=key))
    assert len(got[0]) == len(got[1]) == 63
    for a, b in zip(*got, strict=True):
        assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-9 and abs(a.base_score - b.base_score) < 1e-9


def test_scores_are_stored_without_their_pairs(spark, monkeypatch):
    # key and score of a pair took 12 bytes; the bucket has the pairs, and a score alone takes 4
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 1000))) for i in range(40)], "doc_id long, text string")
    sizes, name = {}, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def stored(table):
        assert spark.conf.get(name) == "4m"
        out = storage.stored(table)
        sizes[tuple(out.columns)] = sum(f.stat().st_size for f in Path(out.stored_at.removeprefix("file:")).rglob("*.parquet"))
        return out

    monkeypatch.setattr(wc, "stored", stored)
    monkeypatch.setattr(wc, "HOT_PAIRS", 10)
    assert wc.score_texts(df).count() == 40 and spark.conf.get(name) == before
    assert max(size for names, size in sizes.items() if "hot_key" in names) < 7 * 40_000
