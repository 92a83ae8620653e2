"""Byte pairs against the library, importance resampling and periodic runs against plain loops."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrasift.llm import resampling
from terrasift.llm.byte_pairs import FIRST, Vocabulary, decode_tokens, encode_texts, leaves
from terrasift.llm.periodic_runs import Ranks, find_runs, longest_previous, lz_blocks, periodic_runs
from terrasift.llm.queries import with_repeated_tails
from terrasift.llm.resampling import feature_hashes, resample

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "a", "b", "ing", "the", "'", "'re", "'ll", "r", "e", "1", "22", ".", "--", "\n", "\t", "é", "日本", "🙂", "<|endoftext|>", "<|endo", "ftext|>", " ", "　", "\x1c", "I", "x" * 20, " " * 17]
SCHEMA = "doc_id long, text string, ids string, part string, key string, weight string, rank int, fit int, runs string, kept string, h int, g int, words string"


def edge_rows():
    texts = [(1, "one two <|endoftext|> it's"), (1, "one two <|endoftext|> it's"), (None, None), (None, "x" * 5000), (None, "x" * 5000), (2, ""), (3, " \n"), (4, "tick tock " * 40_000), (5, "é ü 日本 \x00 word")]
    return [(i, t, "s", "p", "k", "w", 1, 2, "r", "k", 3, 4, "w") for i, t in texts]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_joined_parts_are_the_whole(library):
    own, rng = Vocabulary(PATH), random.Random(5)
    for _ in range(400):
        some = rng.sample(PARTS, rng.randint(1, len(PARTS)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 60)))
        data = text.encode()
        ends = leaves(data, rng.choice([1, 2, 3, 5, 8, 13, 40]))
        ids = own.tree([np.frombuffer(p, np.int32) for p in own.encode(data, ends)])
        assert (ids & (FIRST - 1)).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_unsplit_texts(library):
    own, rng = Vocabulary(PATH), random.Random(1)
    for text in ("a" * 60_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "日本語" * 9_000, " " * 40_000 + "end", "ab" * 9_000 + " " * 9_000 + "'re" * 3_000):
        data = text.encode()
        ids = own.tree([np.frombuffer(p, np.int32) for p in own.encode(data, leaves(data, 1 << 12))])
        assert (ids & (FIRST - 1)).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("long", [1 << 15, 40])
def test_encode_and_decode_rows(spark, edge, library, long):
    got = decode_tokens(encode_texts(edge, PATH, long=long, leaf=24 if long == 40 else 1 << 14), PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    have = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.where("doc_id is null or doc_id <> 4 or 40 < " + str(long)).collect())
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in edge_rows() if r[0] != 4 or long > 40)
    assert have == want
    assert encode_texts(edge.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_feature_hashes_of_any_word_length():
    texts = ["Abc É-1 " + "w" * 64 + " " + "v" * 65 + " x", "", "q" * 300, "a b", "-", "z" * 200 + " y z"]
    data = np.frombuffer("".join(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    row, crc, words = feature_hashes(data, offs)
    for i, t in enumerate(texts):
        n, want = plain_features(t)
        assert words[i] == n and sorted((crc[row == i] % 10_000).tolist()) == sorted(want)


def plain_resample(docs, target, percent=5):
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = collections.Counter(f for r in rows for f in r[2]), collections.Counter(f for x in target for f in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (s_all + 10_000) / ((s[k] + 1) * (t_all + 10_000)))) for k in s}
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {r: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted([(*r, rank.get(r)) for r in out], key=str)


@pytest.mark.parametrize("blocks", [64, 1])
def test_resampling_is_that_of_plain_counts(spark, monkeypatch, blocks):
    monkeypatch.setattr(resampling, "MEET", blocks)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["the", "The", "é1", "run", f"w{rng.randint(0, 300)}", "x-y"]) for _ in range(rng.randint(0, 90)))) for i in range(900)]
    docs += [(2000, "the " * 3000), (2001, None), (2002, ""), (2003, "w" * 200 + " the run" * 9)]
    target = ["the run w1 w2 w3", "", None, "run run é1"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7, "doc_id")
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_resample(docs, target, 30)


def test_resampling_edges(spark, edge):
    target = spark.createDataFrame([("one two",)], "text string")
    got = resample(edge, target, percent=100, least_words=1).collect()
    assert len(got) == len(edge_rows()) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r.n_words > 0 for r in got)))
    assert all((r.n_features, r.weight) == (0, 0) for r in got if r.n_words == 0)
    assert resample(edge.limit(0), target).count() == 0
    assert plain_resample([r[:2] for r in edge_rows()], []) == sorted([tuple(r) for r in resample(edge, target.limit(0)).collect()], key=str)


def plain_runs(words, least, exponent):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q) and i > start:
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


def some_words(rng):
    kind, k, n = rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 60)
    words = [rng.randint(0, k) for _ in range(n)]
    if kind == 1:
        words = [x for _ in range(4) for x in [rng.randint(0, k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)]
    if kind == 2 and words:
        a = rng.randrange(len(words))
        words += words[a : a + rng.randint(1, 20)] * 3
    if kind == 3:  # words of Fibonacci, full of runs
        a, words = [0], [0, 1]
        while len(words) < n:
            a, words = words, words + a
    return words


def test_runs_match_plain_search():
    rng, found = random.Random(3), 0
    for _ in range(400):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        least, exponent = rng.choice([(2, 2), (4, 2), (6, 3), (3, 3), (24, 3)])
        row = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
        got = find_runs(np.array([w for t in texts for w in t], np.uint64), row, least, exponent).tolist()
        want = [[s + sum(map(len, texts[:i])), n, q] for i, t in enumerate(texts) for s, n, q in plain_runs(t, least, exponent)]
        assert got == want, texts
        found += len(want)
    assert found > 2000


def test_longest_previous_factors():
    rng = random.Random(4)
    for _ in range(60):
        w = some_words(rng)
        if not w:
            continue
        length, source = longest_previous(Ranks(np.array(w)))
        for i in range(len(w)):
            best = max((next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)), default=0)
            assert length[i] == best and (not best or (source[i] < i and w[i : i + best] == w[source[i] : source[i] + best]))
        begin = lz_blocks(length).tolist()
        assert all(b - a == max(1, length[a]) for a, b in zip(begin, [*begin[1:], len(w)], strict=True))


def test_run_query_on_changed_texts(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 300)))) for i in range(150)] + [(500, None), (501, ""), (502, "a b " * 5000), (None, "c d\te\n" * 20)]
    got = {r.doc_id: r for r in periodic_runs(with_repeated_tails(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    several = 0
    for i, t in docs:
        w = (t or "").split()
        h = zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want = plain_runs(w, 24, 3)
        gone = {k for s, m, q in want for k in range(s + q, s + m)}
        assert [tuple(r) for r in got[i].runs] == want and got[i].n_words == n
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)
        several += len(want)
    assert several > 5


def test_run_digests(spark, tmp_path):
    from terrasift.llm.queries import op13_periodic_runs

    spark.createDataFrame([(7, "a b c " * 9 + "x " + "p q " * 40 + "y"), (1, "no run here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert zlib.crc32(b"7") % 10 and zlib.crc32(b"1") % 10
    runs = [(0, 27, 3), (28, 80, 2)]
    best = max(runs, key=lambda r: Fraction(r[1], r[2]))
    assert (got[7].n_runs, got[7].start, got[7].length, got[7].period, got[7].exponent_milli) == (2, *best, 40_000)
    assert got[7].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    assert got[7].collapsed_sha256 == hashlib.sha256(b"a b c x p q y").hexdigest()
    assert (got[1].n_runs, got[1].start, got[1].exponent_milli, got[1].runs_sha256) == (0, None, None, hashlib.sha256(b"").hexdigest())


def test_run_edges(spark, edge):
    got = periodic_runs(edge).collect()
    assert len(got) == len(edge_rows()) and {(r.n_words, len(r.runs)) for r in got if r.doc_id == 4} == {(80_000, 1)}
    assert {r.kept for r in got if r.doc_id == 4} == {"tick tock"} and {r.kept for r in got if r.doc_id in (2, 3)} == {""}
    assert periodic_runs(edge.limit(0)).count() == 0
    assert with_repeated_tails(edge).count() == len(edge_rows())
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs(edge, exponent=1)
