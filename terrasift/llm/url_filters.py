"""URL filters: host and path rules first, association rules for the rest. DataFrame and SQL functions only.

Spark's FP-growth mines token combinations of labelled URLs (by default the ones that the host and path rules
judge). Rules "tokens, so block" that are frequent and sure enough, and not idle beside a rule on fewer of their
tokens, are kept as an inverted index from token to rules; a rule matches a URL that has all its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, others, spare, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Between the tokens of a class.
ALIKE = "\0"


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null. For short lists: one test a rule.

    A rule fits its host and all subdomains, if the path starts with the rule's. Equally long rules: the
    first by text.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host and all its domains, all host labels but the last (a domain), all path parts by place, file type, query names; digits as 0."""
    plain = F.regexp_replace(F.regexp_replace(url, r"\x00", ""), "[0-9]+", "0")
    labels = F.split(host_of(plain), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -n, n), ".")))
    parts = F.transform(F.slice(F.split(path_of(plain), "/"), 2, F.length(plain)), lambda p, i: F.concat(F.lit("part"), i.cast("string"), F.lit(":"), p))
    kind = F.transform(F.array(F.regexp_extract(path_of(plain), r"\.([A-Za-z0-9]{1,5})$", 1)), lambda k: F.concat(F.lit("type:"), k))
    query = F.transform(F.regexp_extract_all(plain, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda q: F.concat(F.lit("query:"), q))
    own = F.transform(F.slice(labels, 1, F.size(labels) - 1), lambda x: F.concat(F.lit("label:"), x))
    found = F.array_distinct(F.concat(domains, own, parts, kind, query))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.filter(found, lambda t: ~t.endswith(":")))


def alike(items: DataFrame, least: int) -> dict[str, str]:
    """For each token of at least ``least`` rows of a table (row, tokens) its class: all tokens of exactly the same rows, joined by ``ALIKE``.

    There are at most as many as tokens in a row times rows over ``least``.
    """
    tokens = items.select("row", F.explode("tokens").alias("token"))
    same = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("x"), F.sum(F.shiftright("row", 16)).alias("s")).where(F.col("n") >= least)
    classes = same.groupBy("n", "x", "s").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("tokens")
    return {t: ALIKE.join(r.tokens) for r in classes.toLocalIterator() for t in r.tokens}


def mine_rules(labelled: DataFrame, support: float = 0.01, confidence: float = 0.9, max_rows: int = 100_000, least: int = 5) -> list[tuple[list[str], float, float]]:
    """(classes of tokens, confidence, support) of rules for blocking, from a table (url, block).

    Each distinct URL counts once, so a very frequent one weighs as much as a rare one; FP-growth learns from
    at most ``max_rows`` of them, and a rule rests on at least ``least``. Tokens that always come together are
    one item of FP-growth, named by all of them: what holds of one holds of each, and long URLs of one pattern
    do not make a power set. A token that is sure by itself leaves the baskets before FP-growth, which sees blocked URLs
    only; what its sets have against them is counted over the others by token. All rules that reach support and confidence stay, but for those that a rule on
    fewer of their tokens makes idle: where they match, it matches too.
    """
    some = stored(bounded_sample(labelled.select("url", "block").distinct(), max_rows, "url", "block"))
    items = some.select(F.xxhash64("url", "block").alias("row"), tokens_of(F.col("url")).alias("tokens"), "block").where(F.size("tokens") > 0)
    n = items.count()
    if n < least:
        return []
    support = max(support, least / n)
    names = alike(items, math.ceil(support * n - 1e-9))
    if not names:
        return []
    class_of = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    known = F.array_distinct(F.array_compact(F.transform("tokens", lambda t: F.try_element_at(class_of, t))))
    baskets = stored(items.select("row", known.alias("items"), "block"))
    wanted = max(1, math.ceil(support * n - 1e-9))
    singles = baskets.select("block", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("hits"))
    surely = singles.where((F.col("hits") >= wanted) & (F.col("hits") >= confidence * F.col("n")))
    found = surely.select(F.array("item").alias("tokens"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"))
    # a rule on more tokens is idle if one of them alone is sure, so these leave the baskets; and only sets of blocked rows can block
    sure = [r.item for r in surely.select("item").toLocalIterator()]
    open_rows = baskets.withColumn("items", F.array_except("items", F.array(*map(F.lit, sure)).cast("array<string>"))).where(F.size("items") > 1)
    blocked = stored(open_rows.where("block").select("items"))
    rows = blocked.count()
    if rows >= wanted:
        sets = FPGrowth(itemsCol="items", minSupport=(wanted - 0.5) / rows, minConfidence=1.0).fit(blocked).freqItemsets
        sets = stored(sets.where(F.size("items") > 1).select(F.array_sort("items").alias("tokens"), "freq", F.xxhash64(F.array_sort("items")).alias("set")))
        at = sets.select("set", F.size("tokens").alias("size"), F.explode("tokens").alias("item"))
        other = open_rows.where("not block").select("row", F.explode("items").alias("item")).join(at, "item").groupBy("row", "set", "size").agg(F.count(F.lit(1)).alias("k")).where("k = size")
        against = other.groupBy("set").agg(F.count(F.lit(1)).alias("misses"))
        share = F.col("freq") / (F.col("freq") + F.coalesce("misses", F.lit(0)))
        found = found.unionByName(sets.join(against, "set", "left").where(share >= confidence).select("tokens", share.alias("confidence"), (F.col("freq") / n).alias("support")))
    rules = found
    kept: list[tuple[list[str], float, float]] = []
    having: dict[str, list[int]] = {}
    for r in rules.orderBy(F.size("tokens"), "tokens").toLocalIterator():
        hits = Counter(i for t in r.tokens for i in having.get(t, ()))
        if any(n == len(kept[i][0]) for i, n in hits.items()):
            continue
        for t in r.tokens:
            having.setdefault(t, []).append(len(kept))
        kept.append((list(r.tokens), r.confidence, r.support))
    return sorted(kept, key=lambda x: (-x[1], -x[2], x[0]))


def matches(tokens: Column, rules: list[tuple[list[str], float, float]]) -> Column:
    """Whether any mined rule has a token of each of its classes there: an inverted index from token to class to rules, a constant of the plan."""
    if not rules:
        return F.lit(False)
    classes = sorted({c for own, _, _ in rules for c in own})
    number = F.create_map(*[x for i, c in enumerate(classes) for t in c.split(ALIKE) for x in (F.lit(t), F.lit(i))])
    posting = F.array(*[F.array(*[F.lit(i) for i, (own, _, _) in enumerate(rules) if c in own]) for c in classes])
    sizes = F.array(*[F.lit(len(own)) for own, _, _ in rules])
    there = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.try_element_at(number, t))))
    hits = F.flatten(F.transform(there, lambda c: F.get(posting, c)))
    one = F.transform(F.array(hits), lambda h: F.exists(F.array_distinct(h), lambda i: F.size(F.filter(h, lambda j: j == i)) == F.get(sizes, i)))
    return F.get(one, F.lit(0))


def filter_urls(df: DataFrame, rules: list[HostRule], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict; columns of these names (in any case) are replaced.

    Null URLs, and URLs without ``://``, have empty host and path, fit no rule, have no tokens and are allowed.
    Without mined rules (no labelled URLs, or none to block) what no rule judges is allowed. Repeated rows are
    judged alike.
    """
    kept = others(df.columns, ("host", "path", "rule", "verdict"))
    given = spare("given", [*kept, "host", "path"])
    rows = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn(given, rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where(F.col(given).isNotNull()).select(F.col(url).alias("url"), (F.col(given)["verdict"] == "block").alias("block"))
    mined = mine_rules(labelled)
    other = F.when(matches(tokens_of(F.col(url)), mined), "block").otherwise("allow")
    return rows.select(*kept, "host", "path", F.col(given)["rule"].alias("rule"), F.coalesce(F.col(given)["verdict"], other).alias("verdict"))
