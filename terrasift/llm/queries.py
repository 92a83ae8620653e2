"""Queries of this subpackage over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_pairs import decode_tokens, encode_texts
from .common import bucket_of, documents
from .decontaminate import find_leaks
from .language_model import score_texts
from .media import text_media
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .periodic_runs import periodic_runs
from .personal_data import KINDS, find_personal_data, joined
from .quality import fit_quality, score_quality
from .resampling import resample
from .substrings import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .url_filters import HostRule, filter_urls

# The rules that the URL query applies.
URL_RULES = [
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
]


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("class_key", "row_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, documents(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256)
    return found.select("doc_id", *[number(kind) for kind in KINDS], base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(documents(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", "leak.item_id", "leak.overlap", "leak.item_words", F.round("leak.answer", 6).alias("answer_share"), F.round("leak.cosine", 3).alias("cosine"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir).select("doc_id", "text"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = decode_tokens(encode_texts(documents(spark, sf_dir), path), path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).drop("n_words")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which those that a hash of the id picks repeat a stretch of words from some word on, to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    cut = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    placed = cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(words, cast(a as int) + 1, cast(p as int)), cast(ceil((n - a) / p) as int))), 1, cast(n - a as int))")
    text = F.array_join(F.concat(F.expr("slice(words, 1, cast(a as int))"), tail), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(documents(spark, sf_dir)))
    most = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    times = F.expr("1000 * most.length div most.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "most.start", "most.length", "most.period", times, "runs_sha256", "collapsed_sha256")


def corpus_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix aims at: sizes and targets of sources."""
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"))


def corpus_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of each url, without the verdicts of mined rules."""
    return op7_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


def corpus_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digest of what is read back from the stored media."""
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_mix_sources": op2_mix_sources,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_url_filters": op7_url_filters,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_media_columns": op10_media_columns,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
    "corpus_source_targets": corpus_source_targets,
    "corpus_url_rules": corpus_url_rules,
    "corpus_payloads": corpus_payloads,
}
OP5_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT k, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
 gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (s)),
 tok AS (SELECT k, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
 kept AS (SELECT k, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM tok ANTI JOIN gone USING (k, p) GROUP BY k)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)"""

# Sources in order of the size per weight at which they are full: those up to some place are full, the others share the rest by weight.
TARGETS_SQL = r"""WITH n AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS s FROM documents GROUP BY 1),
 w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM n),
 o AS (SELECT *, row_number() OVER k AS p, sum(2.0 * s) OVER k AS full_upto, sum(w) OVER () - sum(w) OVER k AS rest, 1.5 * sum(s) OVER () AS total, 2.0 * s / w AS full_at FROM w WINDOW k AS (ORDER BY 2.0 * s / w, source ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT p, CASE WHEN rest > 1e-9 THEN (total - full_upto) / rest END AS level, lead(full_at) OVER (ORDER BY p) AS next FROM o UNION ALL SELECT 0, any_value(total) / any_value(rest + w), min(full_at) FROM o WHERE p = 1),
 b AS (SELECT min(p) AS p, arg_min(level, p) AS level FROM l WHERE next IS NULL OR next > level)
 SELECT source, s AS source_size, round(CASE WHEN o.p <= b.p THEN 2.0 * s ELSE w * level END, 6) AS target FROM o, b"""
URL_SQL = r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 r(h, p) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
 SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL"""
PAYLOAD_SQL = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), p AS (SELECT doc_id, t, octet_length(t) AS n, greatest(64, (octet_length(t) + 63) // 64 * 64) AS m FROM b)
 SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(t || unhex(repeat('00', CAST(m - n AS INTEGER)))) AS payload_sha256, CAST(m + 44 AS BIGINT) AS media_bytes FROM p"""

#: The others train, sample or shuffle by hashes that SQL engines do not share; tests/llm has their brute force.
ORACLES: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "corpus_source_targets": TARGETS_SQL, "corpus_url_rules": URL_SQL, "corpus_payloads": PAYLOAD_SQL}
