"""Personal data by boosted candidates, in DataFrame and SQL functions only.

Four kinds have a fixed format and a check (email, ip, card, phone); those spans always stay. Generators of
high recall propose more spans, each on its own, so proposals may overlap the base spans and each other:
secrets given to a name, account numbers, long numbers, phone numbers without a country, addresses spelled
out. Gradient-boosted trees judge each by format and context, and a calibrated cut selects. The trees learn
from evidence beside the patterns (check digits, what a span is called, what it is glued to) in all rows and
are then written out as a SQL expression, so that all rows are judged inside their own row: no shuffle, no
Python.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, spare, stored

# The formats. The quantifiers are possessive, which finds the same spans (what follows a run
# is never part of it) without backtracking or deep recursion in long texts; a card needs 13 digits to pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

class Generator(NamedTuple):
    """A pattern, and a cheap one without which it has no match. Runs are taken to their end, however long."""

    pattern: str
    needs: str


#: Generators by the kind they propose.
GENERATORS = {
    "secret": Generator(r"(?i:token|secret|passw(?:or)?d|api[_-]?key|key)[\x20]?[=:][\x20]?[\"']?(?=[A-Za-z0-9_+/.-]{8})[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+", r"(?i:token|secret|passw|key)"),
    "account": Generator(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,}+|(?:\x20[A-Z0-9]{4}){2,}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "contact": Generator(r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++[\x20]?[\[(](?i:at)[\])][\x20]?[A-Za-z0-9-]++[\x20]?(?:\.|[\[(](?i:dot)[\])])[\x20]?[A-Za-z]{2,}+", r"[\[(](?i:at)[\])]"),
    "national": Generator(r"(?<![0-9(+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{3}[\x20.-][0-9]{4}"),
    "number": Generator(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{9,}+", "[0-9]{9}|[0-9]-[0-9]{2}-[0-9]"),
}

# What spans are called, by generator, right before them or within them.
CALLED = {
    "secret": "token|secret|passw|key",
    "account": "iban|account|acct|konto|cuenta|compte",
    "contact": "mail|contact|write",
    "national": "tel|phone|call|fax|mobile|cell|t\u00e9l",
    "number": "account|acct|ssn|social|passport|konto|cuenta|compte|card",
}
#: What says that a number is none of a person.
SERIAL = r"(?i)(?:order|item|invoice|ref|serial|part|page|article|isbn|no\.?|nr\.?|#)[\x20:#=.]{0,3}$"

#: Matches that one inner fold appends.
BLOCK = 128

FEATURES = ("length", "digits", "letters", "separators", "upper", "named", "serial", "glued", "quoted", "checks", "mixed", "plus", *GENERATORS)


def spans_of(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, value, before) of the pattern's leftmost non-overlapping matches, in code points.

    The text is split by the pattern as well as matched by it; starts are sums of what lies before. ``needs``
    is a cheap pattern without which there is no match.
    """
    span = "array<struct<start: bigint, end: bigint, value: string, before: string>>"
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(24)).alias("before"))
        return F.struct(end.cast("long").alias("at"), F.when(x["value"].isNotNull(), F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    def add_block(acc: Column, block: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.array().cast(span).alias("spans"))
        done = F.array(F.aggregate(block, zero, add))
        return F.get(F.transform(done, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["spans"])).alias("parts"))), F.lit(0))

    # appending copies what is there already: blocks keep that far below the square of the matches
    def in_blocks(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("parts"))
        return F.aggregate(blocks, zero, add_block, lambda acc: F.flatten(acc["parts"]))

    found = F.get(F.transform(F.array(pieces), in_blocks), F.lit(0))
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(span))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind with a format, after its check."""
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

    def checked(kind: str) -> Column:
        return F.filter(spans_of(text, KINDS[kind], needs[kind]), lambda s: valid(kind, s["value"]))

    return {kind: checked(kind) for kind in KINDS}


def proposals(text: Column) -> Column:
    """Array of (kind, start, end, value, before) of what the generators propose; each runs on its own."""

    def of(kind: str, g: Generator) -> Column:
        return F.transform(spans_of(text, g.pattern, g.needs), lambda s: F.struct(F.lit(kind).alias("kind"), *[s[k].alias(k) for k in ("start", "end", "value", "before")]))

    return F.concat(*[of(kind, g) for kind, g in GENERATORS.items()])


def mod97(value: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest) leaves 1 by 97."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")

    def add(acc: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code.between(48, 57), (acc * 10 + code - 48) % 97).when(code.between(65, 90), (acc * 100 + code - 55) % 97).otherwise(acc)

    return F.aggregate(turned, F.lit(0), add) == 1


def called(s: Column) -> Column:
    """Whether the words just before a proposal, or its own, call it what its generator looks for."""
    out = F.lit(False)
    for kind, words in CALLED.items():
        near = rf"(?i)(?:{words})[^\n]{{0,12}}$"
        out = F.when(s["kind"] == kind, s["before"].rlike(near) | s["value"].rlike(f"^(?i:{words})")).otherwise(out)
    return out


def evidence(s: Column) -> Column:
    """1.0 if something beside its pattern says that a proposal is personal, 0.0 if something says it is not, else null."""
    value, digits = s["value"], F.length(digits_of(s["value"]))
    given = F.regexp_extract(value, r"[=:][\x20]?[\"']?(.*)$", 1)
    serial = s["before"].rlike(SERIAL)
    glued = s["before"].rlike("[A-Za-z]$")
    no, yes = F.lit(0.0), F.lit(1.0)
    by = {
        "secret": F.when(given.rlike("[0-9]") & given.rlike("[A-Za-z]") & (F.length(given) >= 16), yes).when(given.rlike("^[a-z.]*$"), no),
        "account": F.when(mod97(value), yes).otherwise(no),
        "contact": F.when(value.rlike(r"(?i)[\[(]dot[\])]") | called(s), yes).when(value.rlike(r"(?i)[\])][\x20]?[0-9]+[\x20]?\."), no),
        "national": F.when(serial, no).when(called(s), yes),
        "number": F.when(glued | serial | (digits > 40), no).when(called(s), yes).when(digits.between(13, 19), no),  # it would be a card, but the check fails
    }
    out = F.lit(None).cast("double")
    for kind, e in by.items():
        out = F.when(s["kind"] == kind, e).otherwise(out)
    return out


def features(s: Column) -> dict[str, Column]:
    """Format and context of a proposal."""
    value, digits = s["value"], digits_of(s["value"])
    count = lambda c: F.length(F.regexp_replace(value, f"[^{c}]", "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": F.length(value).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": count("A-Za-z"),
        "separators": count(r"\x20().\[\]-"),
        "upper": count("A-Z"),
        "named": flag(called(s)),
        "serial": flag(s["before"].rlike(SERIAL)),
        "glued": flag(s["before"].rlike("[A-Za-z]$")),
        "quoted": flag(value.rlike("[\"']")),
        "checks": flag(F.when(s["kind"] == "account", mod97(value)).when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)),
        "mixed": flag(value.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]")),
        "plus": flag(s["before"].rlike(r"\+[0-9]{0,3}[\x20]?$")),
        **{kind: flag(s["kind"] == kind) for kind in GENERATORS},
    }


def _tree(lines: list[str]) -> tuple | float:
    """A tree of a model's printout: (feature, cut, low, high), or what a leaf predicts."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    number, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)  # Else
    return FEATURES[int(number)], float(cut), low, _tree(lines)


def _trees(printout: str) -> list[tuple | float]:
    lines: list[list[str]] = []
    for line in printout.splitlines()[1:]:
        if line.strip().startswith("Tree "):
            lines.append([])
        elif line.strip():
            lines[-1].append(line)
    return [_tree(x) for x in lines]


def _value(tree: tuple | float, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, cut, low, high = tree
    return F.when(f[name] <= cut, _value(low, f)).otherwise(_value(high, f))


class Judge(NamedTuple):
    """Boosted trees with their weights, and the cut on the weighted sum."""

    trees: list[tuple | float]
    weights: list[float]
    cut: float

    def margin(self, f: Column) -> Column:
        return F.round(sum((w * _value(t, f) for w, t in zip(self.weights, self.trees, strict=True)), F.lit(0.0)), 9)


def fit_candidates(df: DataFrame, text: str = "text", row_id: str = "doc_id", precision: float = 0.9) -> Judge | None:
    """Boosted trees fitted to the proposals of all rows, and the cut on their margin.

    A proposal is an example if ``evidence`` decides it; undecided ones, and those within a checked base span,
    stay out of the fit. Examples of equal features and label are one row with their number as its weight, so the
    fit grows with the distinct ones. The cut is the least margin above which a share of ``precision`` of the examples
    of a third of the rows, kept from the fit, is personal. Without examples of both sorts, or such a margin, there is no judge.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    some = df.where(body.rlike("|".join(g.needs for g in GENERATORS.values())))
    rows = some.select(F.xxhash64(row_id, text).alias("row"), F.concat(*base_spans(body).values()).alias("base"), proposals(body).alias("proposals"))
    rows = rows.select("row", "base", F.explode("proposals").alias("p"))
    inside = F.exists("base", lambda b: (b["start"] <= F.col("p.start")) & (F.col("p.end") <= b["end"]))
    marked = rows.where(~inside).select((F.pmod("row", F.lit(3)) == 0).alias("check"), evidence(F.col("p")).alias("label"), F.struct(*[c.alias(k) for k, c in features(F.col("p")).items()]).alias("f"))
    marked = stored(marked.where("label is not null").groupBy("check", "label", "f").agg(F.count(F.lit(1)).cast("double").alias("n")).select("check", "label", "n", "f.*"))
    if marked.where("not check").select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxIter=8, maxDepth=3, maxBins=256, seed=3, stepSize=0.3).fit(vector.transform(marked.where("not check")))
    judge = Judge(_trees(model.toDebugString), [float(w) for w in model.treeWeights], 0.0)
    scored = marked.where("check").select("label", "n", F.struct(*FEATURES).alias("f")).select("label", "n", judge.margin(F.col("f")).alias("margin"))
    steps = scored.groupBy("margin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("all")).orderBy(F.desc("margin")).collect()
    cut, good, total = None, 0.0, 0.0
    for step in steps:
        good, total = good + step["good"], total + step["all"]
        if good >= precision * total:
            cut = step["margin"] - 1e-9
    return None if cut is None else judge._replace(cut=cut)


def outside(s: Column, base: Column) -> Column:
    """What of a span the base spans leave: array of (start, end)."""
    piece = "array<struct<start: bigint, end: bigint>>"

    def cut(acc: Column, b: Column) -> Column:
        fresh = F.array(F.struct(acc["at"].alias("start"), F.least(b["start"], s["end"]).alias("end")))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(F.least(b["start"], s["end"]) > acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(s["start"].alias("at"), F.array().cast(piece).alias("out"))
    rest = lambda acc: F.when(acc["at"] < s["end"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["end"].alias("end"))))).otherwise(acc["out"])
    touching = F.array_sort(F.transform(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    return F.aggregate(touching, zero, cut, rest)


def find_personal_data(df: DataFrame, text: str = "text", row_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, base), in order of kind and start; a column of that name (in any case) is replaced.

    Spans with ``base`` have a checked format and always stay. Added spans never overlap these: of a proposal
    that does, the parts outside are added. Added spans may overlap each other. Without a judge, what has
    evidence is added. Null and empty texts have no spans; the whole text is read; repeated rows get equal spans.
    """
    kept = others(df.columns, (spans,))
    judge = fit_candidates(df, text, row_id)
    body = F.coalesce(F.col(text), F.lit(""))
    bases = base_spans(body)
    own = {k: spare(f"_{k}", kept) for k in (*KINDS, "more", "base")}
    rows = df.select(*kept, *[c.alias(own[k]) for k, c in bases.items()], proposals(body).alias(own["more"]))

    def named(kind: str) -> Column:
        return F.transform(own[kind], lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))

    rows = rows.select(*kept, F.concat(*[named(kind) for kind in KINDS]).alias(own["base"]), own["more"])

    def judged(s: Column) -> Column:
        if judge is None:
            return F.coalesce(evidence(s) == 1.0, F.lit(False))
        seen = F.array(F.struct(*[c.alias(k) for k, c in features(s).items()]))
        return F.exists(seen, lambda f: judge.margin(f) >= judge.cut)

    added = F.flatten(F.transform(F.filter(own["more"], judged), lambda s: F.transform(outside(s, F.col(own["base"])), lambda x: F.struct(s["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("base")))))
    return rows.select(*kept, F.concat(own["base"], F.array_distinct(F.array_sort(added))).alias(spans))


def redact(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The text with each span replaced by its kind in brackets, and no other change; columns stay as they are.

    Where added spans overlap each other, the one that starts first is replaced and what it covers goes with it.
    """
    name = spare("spans", df.columns)
    found = find_personal_data(df, text, row_id, name)
    spans = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(text)

    def put(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), fresh.alias("out"))).otherwise(acc)

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, put, lambda acc: F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"))))
    return found.withColumn(text, F.when(F.size(name) > 0, whole).otherwise(body)).select(*df.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
