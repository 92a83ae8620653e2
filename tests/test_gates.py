"""Gates: one card that passes, and one change a time that must not."""

from pyspark.sql import functions as F

from terrasift.operators import gates
from terrasift.plans.gate_queries import run_cards


def test_each_fault_has_its_reason(spark):
    cards = run_cards(spark, "/root/testdata/sf0.001")
    good = cards.where("id % 7 <> 0 and id % 5 <> 0").withColumn("id", F.lit(1))
    passed = gates.promotion_gate(good).where("promoted")
    assert passed.count() >= 1
    card = passed.limit(1).drop("failures", "promoted")
    card = spark.createDataFrame(card.collect(), cards.schema)
    sha = F.lit("a" * 64)
    changes = {
        "missing assigned method lane": card.withColumn("lane", F.lit(None).cast("string")),
        "note must contain 1 to 140 characters": card.withColumn("note", F.lit("")),
        "missing raster SHA-256": card.withColumn("raster_sha256", F.lit("XYZ")),
        "holdout raster hash mismatch": card.withColumn("raster_sha256", sha),
        "not the shared evaluator": card.withColumn("holdout", F.col("holdout").withField("label", F.lit("other"))),
        "invalid holdout interval": card.withColumn("holdout", F.col("holdout").withField("ci95", F.array(F.lit(0.6), F.lit(0.75)))),
        "gain is not candidate minus baseline, or not positive": card.withColumn("holdout", F.col("holdout").withField("paired_gain", F.lit(0.3))),
        "no positive interval around the gain": card.withColumn("holdout", F.col("holdout").withField("paired_gain_ci95", F.array(F.lit(0.0), F.lit(0.5)))),
        "wrong metric protocol": card.withColumn("holdout", F.col("holdout").withField("alpha", F.lit(0.3))),
        "protocol missing: buffered": card.withColumn("holdout", F.col("holdout").withField("buffered", F.lit(None).cast("boolean"))),
        "invalid or leaking feature: a": card.withColumn("feature_canaries", F.create_map(F.lit("a"), F.lit(0.05), F.lit("b"), F.lit(0.5))),
        "canaries must cover every feature exactly": card.withColumn("feature_canaries", F.create_map(F.lit("a"), F.lit(0.5))),
        "registry incomplete": card.withColumn("registry", F.col("registry").withField("complete", F.lit(False))),
        "duplicate registry members": card.withColumn("registry", F.col("registry").withField("members", F.array(sha, sha))),
        "no dots comparisons": card.withColumn("registry", F.col("registry").withField("dots", F.slice("registry.dots", 1, 0))),
        "validator failed: crs_match": card.withColumn("validator", F.col("validator").withField("crs_match", F.lit(False))),
        "missing hypothesis, mechanism or confounder": card.withColumn("non_fault_mimic", F.lit(" ")),
    }
    out = None
    for reason, changed in changes.items():
        one = changed.select(F.lit(reason).alias("reason"), *card.columns)
        out = one if out is None else out.unionByName(one)
    rows = gates.promotion_gate(out).select("reason", "failures", "promoted").collect()
    assert len(rows) == len(changes) and all(r.reason in r.failures and not r.promoted for r in rows)
    assert gates.promotion_gate(cards.limit(0)).count() == 0
