"""Fail-closed gates over tables of run cards and run plans: every check that does not hold is a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA = "^[0-9a-f]{64}$"
#: What the shared evaluator calls its score and itself.
LABEL, EVALUATOR = "holdout-score", "segment-pooled-v1"
PROTOCOL = ("whole_segments", "buffered", "visible_only_features", "pixel_exact_visible_mask", "pooled")
VALIDATED = ("no_nan_inside", "range_0_1", "crs_match", "shape_match", "transform_match", "single_band")


def holds(test: Column) -> Column:
    """Null counts as not."""
    return F.coalesce(test, F.lit(False))


def reasons_of(checks: list[tuple[Column | str, Column]]) -> Column:
    """Reasons of the checks that do not hold, in their order. A reason may be a column."""
    found = [F.when(~holds(test), F.lit(name) if isinstance(name, str) else name) for name, test in checks]
    return F.array_compact(F.array(*found))


def text(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def within(c: Column, low: float, high: float) -> Column:
    return finite(c) & c.between(low, high)


def promotion_gate(cards: DataFrame, label: str = LABEL, evaluator: str = EVALUATOR) -> DataFrame:
    """Adds ``failures`` and ``promoted`` to run cards.

    A card has lane, raster_sha256, submission_name, note, hypothesis, mechanism, non_fault_mimic, feature_names
    (array), feature_canaries (map to double), and the structs holdout, registry and validator. The holdout must be the
    evaluator's, under its label. Anything missing fails; nothing that is null passes.
    """
    h, g, v = (lambda k: F.col("holdout")[k]), (lambda k: F.col("registry")[k]), (lambda k: F.col("validator")[k])
    ci, gain_ci = h("ci95"), h("paired_gain_ci95")
    score, base, gain = h("dti"), h("baseline_dti"), h("paired_gain")
    names, canaries = F.col("feature_names"), F.col("feature_canaries")
    members = g("members")
    close = F.abs(gain - (score - base)) <= F.greatest(1e-6 * F.greatest(F.abs(gain), F.abs(score - base)), F.lit(1e-8))
    named = holds((F.size(names) > 0) & F.forall(names, lambda n: holds(text(n))) & (F.size(F.array_distinct(names)) == F.size(names)))
    known = holds((F.size(members) > 0) & F.forall(members, lambda m: holds(m.rlike(SHA))))
    checks: list[tuple[Column | str, Column]] = [
        ("missing assigned method lane", text(F.col("lane"))),
        ("missing raster SHA-256", F.col("raster_sha256").rlike(SHA)),
        ("missing submission name", text(F.col("submission_name"))),
        ("note must contain 1 to 140 characters", F.length("note").between(1, 140)),
        ("missing hypothesis, mechanism or confounder", text(F.col("hypothesis")) & text(F.col("mechanism")) & text(F.col("non_fault_mimic"))),
        ("holdout raster hash mismatch", text(h("raster_sha256")) & (h("raster_sha256") == F.col("raster_sha256"))),
        ("missing frozen baseline hash", h("baseline_sha256").rlike(SHA)),
        ("not the shared evaluator", (h("label") == label) & (h("evaluator_version") == evaluator)),
        ("missing withheld positives", h("withheld_positives") > 0),
        ("invalid holdout score", within(score, 0, 1)),
        ("invalid holdout interval", (F.size(ci) == 2) & finite(ci[0]) & finite(ci[1]) & (ci[0] >= 0) & (ci[0] <= score) & (score <= ci[1]) & (ci[1] <= 1)),
        ("invalid baseline score", within(base, 0, 1)),
        ("gain is not candidate minus baseline, or not positive", finite(gain) & (gain > 0) & close),
        ("no positive interval around the gain", (F.size(gain_ci) == 2) & finite(gain_ci[0]) & finite(gain_ci[1]) & (gain_ci[0] > 0) & (gain_ci[0] <= gain) & (gain <= gain_ci[1]) & (gain_ci[1] <= 1)),
        *[(f"protocol missing: {k}", h(k)) for k in PROTOCOL],
        ("wrong metric protocol", (h("alpha") == 0.2) & (h("beta") == 0.8) & (h("kernel_m") == 300) & (h("kernel") == "triangular")),
        ("missing or invalid feature list", named),
        ("no feature canaries", F.size(canaries) > 0),
        ("canaries must cover every feature exactly", named & (F.array_sort(F.map_keys(canaries)) == F.array_sort(names))),
    ]
    leaking = F.transform(F.filter(F.array_sort(F.map_entries(canaries)), lambda e: ~holds(text(e["key"]) & within(e["value"], 0.1, 0.9))), lambda e: F.concat(F.lit("invalid or leaking feature: "), e["key"]))
    later: list[tuple[Column | str, Column]] = [
        ("registry incomplete", g("complete") & g("manifest_sha256").rlike(SHA)),
        ("invalid registry members", known),
        ("duplicate registry members", ~known | (F.size(F.array_distinct(members)) == F.size(members))),
    ]
    for stage in ("surface", "dots"):
        rows = g(stage)
        own = F.transform(rows, lambda x: x["raster_sha256"])
        near = F.transform(rows, lambda x: x["within_3px_fraction"])
        # before dots are placed there is no overlap; where there is one, it must pass
        fits = F.forall(near, lambda x: holds(within(x, 0, 0.7))) if stage == "dots" else F.forall(near, lambda x: x.isNull() | holds(within(x, 0, 0.7)))
        later += [
            (f"no {stage} comparisons", F.size(rows) > 0),
            (f"{stage} comparison without identity", F.forall(rows, lambda x: holds(x["raster_sha256"].rlike(SHA)))),
            (f"{stage} correlation duplicate or undefined", F.forall(rows, lambda x: holds(within(x["spearman"], -0.9, 0.9)))),
            (f"{stage} overlap duplicate or undefined", fits),
            (f"{stage} comparisons must cover every member once", known & (F.array_sort(own) == F.array_sort(members))),
        ]
    later += [("validator hash mismatch", v("raster_sha256") == F.col("raster_sha256")), *[(f"validator failed: {k}", v(k)) for k in VALIDATED]]
    failures = F.concat(reasons_of(checks), F.coalesce(leaking, F.array().cast("array<string>")), reasons_of(later))
    return cards.withColumn("failures", failures).withColumn("promoted", F.size("failures") == 0)


def preflight_gate(plans: DataFrame, members: DataFrame, files: DataFrame, now: Column, label: str = LABEL, evaluator: str = EVALUATOR) -> DataFrame:
    """Adds ``failures`` and ``allowed`` to run plans.

    plans: plan_id, lane, lane_source, registry_complete, baseline (struct label, evaluator_version, strict, dti,
    ci95, withheld_positives), time_cap_seconds, experiments_run, experiment_cap, started_at, slot_selected.
    members: plan_id, path, sha256. files: path, content. A member must be there, have its hash and be no copy.
    """
    digest = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_digest"))
    seen = members.join(digest, F.col("path") == F.col("_path"), "left").withColumn("ok", holds(F.col("_digest") == F.col("sha256")))
    state = seen.groupBy(F.col("plan_id").alias("_plan")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("ok")).alias("_bad"), F.count_distinct("_digest").alias("_kinds"), F.count("_digest").alias("_found"))
    both = plans.join(state, F.col("plan_id") == F.col("_plan"), "left")
    b = lambda k: F.col("baseline")[k]
    ci = b("ci95")
    elapsed = now.cast("double") - F.col("started_at").cast("double")
    failures = reasons_of([
        ("missing lane or its source", text(F.col("lane")) & text(F.col("lane_source"))),
        ("registry is not complete with members", F.col("registry_complete") & (F.col("_n") > 0)),
        ("registry member missing or changed", F.coalesce(F.col("_bad"), F.lit(0)) == 0),
        ("registry member repeated", F.coalesce(F.col("_kinds") == F.col("_found"), F.lit(True))),
        ("baseline under another protocol", (b("label") == label) & (b("evaluator_version") == evaluator) & b("strict")),
        ("baseline lacks score, interval or count", within(b("dti"), 0, 1) & (F.size(ci) == 2) & (ci[0] >= 0) & (ci[0] <= b("dti")) & (b("dti") <= ci[1]) & (ci[1] <= 1) & (b("withheld_positives") >= 1)),
        ("time budget invalid", F.col("time_cap_seconds").between(1, 7200)),
        ("experiment budget exhausted or invalid", (F.col("experiments_run") >= 0) & (F.col("experiments_run") < F.col("experiment_cap")) & (F.col("experiment_cap") <= 3)),
        ("time used up or start in the future", (elapsed >= 0) & (elapsed < F.col("time_cap_seconds"))),
        ("a slot must not be selected", ~F.coalesce(F.col("slot_selected"), F.lit(False))),
    ])
    return both.withColumn("failures", failures).withColumn("allowed", F.size("failures") == 0).select(*plans.columns, "failures", "allowed")


def graph_argument(length_km: Column, a: Column, b: Column, len_a: Column, len_b: Column, merged: Column, gain: Column, share: Column, bridge: Column) -> Column:
    """One paragraph that a reviewer can judge a link by."""
    tail = F.when(bridge, "It is a bridge: no other candidate link joins these two sides.").otherwise("It is no bridge: another candidate link joins these two sides already.")
    return F.format_string("Closing this %.2f km gap joins systems %s and %s of %.2f km and %.2f km into one of %.2f km; connectivity changes by %+.4f and the largest system's share by %+.5f. %s", length_km, a.cast("string"), b.cast("string"), len_a, len_b, merged, gain, share, tail)
