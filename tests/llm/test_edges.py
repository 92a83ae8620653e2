"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for each operator."""

import pytest

from terrasift.llm.decontaminate import find_leaks
from terrasift.llm.language_model import score_texts
from terrasift.llm.media import text_media
from terrasift.llm.mixing import mix_sources
from terrasift.llm.near_duplicates import near_duplicates
from terrasift.llm.personal_data import find_personal_data, redact
from terrasift.llm.quality import fit_quality, score_quality
from terrasift.llm.substrings import remove_repeats
from terrasift.llm.toxicity import fit_toxicity, score_toxicity
from terrasift.llm.url_filters import HostRule, filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, root string, h int, score string, spans string, earlier int, row_key int, _base int, `a b` int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))


def rows():
    out = [(1, "one two three mail me at a.b@c.org"), (1, "one two three mail me at a.b@c.org"), (None, None), (None, "same text"), (2, ""), (3, " \n"), (4, LONG), (5, "é ü 1.2.3.4 word"), (6, "short")]
    return [(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{i % 2}", None, "k", "r", 1, "s", "p", 2, 3, 4, 5) for i, t in out]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


ALL = sorted(str(r[0]) for r in rows())


def test_language_model(edge, none):
    got = score_texts(edge)
    assert ids(got) == ALL
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert (None, 1) in by and (2, 1) in by and (3, 1) in by and (4, 40_001) in by
    assert score_texts(none).count() == 0


def test_mixing(edge, none):
    got = mix_sources(edge).collect()
    assert sorted(str(r.doc_id) for r in got) == ALL
    assert all(r.taken == 0 for r in got if r.size == 0) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mix_sources(none).count() == 0


def test_near_duplicates(edge, none):
    got = near_duplicates(edge).collect()
    assert sorted(str(r.doc_id) for r in got) == ALL
    assert [r.class_size for r in got if r.doc_id == 1] == [2, 2]
    assert all(r.class_size == 1 for r in got if r.doc_id in (2, 3, 4, 5, 6))
    assert near_duplicates(none).count() == 0


def test_toxicity_and_quality(edge, none, labels):
    empty = labels.limit(0)
    for fit, score, neutral in ((fit_toxicity, score_toxicity, 0.0), (fit_quality, score_quality, 0.7)):
        for known in (labels, empty):
            got = score(edge, fit(edge, known))
            assert got.columns[-1] == "score" and ids(got) == ALL
            assert all(0 <= r.score <= 1 for r in got.collect())
        assert {r.score for r in score(edge, None).collect()} == {neutral}
        assert score(none, fit(none, labels)).count() == 0


def test_substrings(edge, none):
    got = {(r.doc_id, r.n_words): r for r in remove_repeats(edge, length=4).collect()}
    assert got[1, 7].n_removed == 7 and got[1, 7].kept == "" and got[4, 40_000].n_removed > 0
    assert got[None, 0].kept == "" and got[None, 2].kept == "same text" and got[5, 4].n_removed == 0
    assert remove_repeats(edge).count() == len(ALL)
    assert remove_repeats(none).count() == 0


def test_personal_data(edge, none):
    got = find_personal_data(edge)
    assert ids(got) == ALL and set(got.columns) == set(edge.columns)
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got.collect()}
    assert by[1] == [("email", 25, 34)] and by[5] == [("ip", 4, 11)] and by[2] == [] and by[4] == []
    assert find_personal_data(none).count() == 0
    clean = redact(edge)
    assert clean.columns == edge.columns and {r.spans for r in clean.collect()} == {"p"}
    assert {r.text for r in clean.where("doc_id = 5").collect()} == {"é ü [ip] word"}


def test_leaks(spark, edge, none):
    items = spark.createDataFrame([(1, "one two three mail me at a b c org"), (2, None), (3, ""), (3, "unseen words only here and there")], "item_id int, text string")
    got = find_leaks(edge, items)
    assert got.columns == [*edge.columns, "leaks"] and ids(got) == ALL
    assert {r.doc_id for r in got.collect() if r.leaks} == {1}
    assert find_leaks(edge, items.limit(0)).where("size(leaks) > 0").count() == 0
    assert find_leaks(none, items).count() == 0


def test_media(edge, none):
    got = text_media(edge)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].n_bytes == 0 and by[2].payload_bytes == 64 and by[None].payload_bytes == 64
    assert text_media(none).count() == 0


def test_urls(spark):
    rules = [HostRule("com", "/", "allow"), HostRule("b.com", "/x/", "block")]
    df = spark.createDataFrame([(1, "http://A.b.com/x/1?q=1", "h"), (1, "http://A.b.com/x/1?q=1", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "http://b.com", "h"), (5, "", "h"), (6, "://c.com#f", "h")], "page_id int, url string, rule string")
    got = {r.page_id: r for r in filter_urls(df, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.b.com", "/x/1", "b.com/x/", "block")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (2, 3, 5))
    assert got[4].path == "" and got[4].rule is None and got[6].host == "c.com"
    assert filter_urls(df.limit(0), rules).count() == 0
