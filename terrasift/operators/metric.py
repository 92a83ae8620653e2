"""Distance-weighted detection scores of dots against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import forward_score, kernel, tversky
from .neighbours import KERNEL, offsets, spread
from .statistics import blind_credit


def credit(truth: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    """Truth cells with ``k``, the largest kernel value (times weight ``p``, if there is one) of any dot."""
    key = ["r", "c", *by]
    value = kernel(F.col("d2")) * (F.col("p") if "p" in pred.columns else F.lit(1.0))
    reach = spread(pred.select(*key, *(["p"] if "p" in pred.columns else [])), KERNEL).groupBy(*key).agg(F.max(value).alias("k"))
    return truth.join(reach, key, "left").withColumn("k", F.coalesce("k", F.lit(0.0)))


def score(pred: DataFrame, truth: DataFrame, known: DataFrame | None = None, *by: str) -> DataFrame:
    """One row (per value of ``by``): tp, fp, n, dots, score, recall.

    Known cells leave both masks first. ``pred`` may carry a probability ``p``. tp adds up what truth cells
    get from their best dot, fp what dots lack to their best truth cell. Without truth the score is 0.
    """
    if known is not None:
        pred, truth = pred.join(known, ["r", "c"], "left_anti"), truth.join(known, ["r", "c"], "left_anti")
    soft = "p" in pred.columns
    tp = credit(truth, pred, *by).select(*by, F.col("k").alias("tp"), F.lit(0.0).alias("fp"), F.lit(1).alias("n"), F.lit(0).alias("dots"))
    best = credit(pred.select("r", "c", *by, *([F.col("p").alias("own")] if soft else [])), truth.select("r", "c", *by), *by)
    lack = (1 - F.col("k")) * (F.col("own") if soft else F.lit(1.0))
    fp = best.select(*by, F.lit(0.0).alias("tp"), lack.alias("fp"), F.lit(0).alias("n"), F.lit(1).alias("dots"))
    out = tp.unionByName(fp).groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "n", "dots")])
    return out.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("n"))).withColumn("recall", F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0))


def sums_or_null(scores: DataFrame) -> DataFrame:
    """Scores with nulls where SQL has them: tp without truth, fp without dots, and what follows from either."""
    some, dots = F.col("n") > 0, F.col("dots") > 0
    null = {"tp": F.when(some, F.col("tp")), "fp": F.when(dots, F.col("fp")), "score": F.when(some & dots, F.col("score")), "recall": F.when(some, F.col("recall"))}
    return scores.select(*[null[c].alias(c) if c in null else c for c in scores.columns])


def marginal_gain(base: DataFrame, more: DataFrame, truth: DataFrame) -> DataFrame:
    """(d_tp, d_fp, n, dots): what added dots change, truth cells, and dots of the base."""
    both = score(base.unionByName(more).distinct(), truth).select(F.col("tp").alias("t1"), F.col("fp").alias("f1"))
    one = score(base, truth).select(F.col("tp").alias("t0"), F.col("fp").alias("f0"), "n", "dots")
    return both.join(one, F.lit(True)).select((F.col("t1") - F.col("t0")).alias("d_tp"), (F.col("f1") - F.col("f0")).alias("d_fp"), "n", "dots")


def pooled(rows: DataFrame, arm: str, *levels: str) -> DataFrame:
    """Sums of tp, fp, n over rows, then the ratio; with levels, all their rollups in one pass."""
    grouped = rows.groupBy(arm) if not levels else rows.rollup(arm, *levels)
    out = grouped.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "n")])
    return out.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("n")))


def overlap(candidate: DataFrame, reference: DataFrame, most_d2: int = 9) -> DataFrame:
    """Share of candidate dots within the radius of a reference dot; null without candidates."""
    reach = spread(reference.select("r", "c"), offsets(most_d2)).select("r", "c").distinct().withColumn("hit", F.lit(1))
    return candidate.join(reach, ["r", "c"], "left").agg(F.count(F.lit(1)).alias("dots"), F.count("hit").alias("inside"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def coverage(dots: DataFrame) -> DataFrame:
    """(r, c, cover): sum of kernel values of all dots, where positive."""
    return spread(dots.select("r", "c"), KERNEL).groupBy("r", "c").agg(F.sum(kernel(F.col("d2"))).alias("cover"))


def gain_map(candidates: DataFrame, weight: DataFrame, cover: DataFrame) -> DataFrame:
    """(r, c, gain): what each candidate adds, sum of w * max(0, k - cover), over its surroundings."""
    field = weight.join(cover, ["r", "c"], "left").select("r", "c", "w", F.coalesce("cover", F.lit(0.0)).alias("cover"))
    own = spread(candidates.select("r", "c", F.col("r").alias("r0"), F.col("c").alias("c0")), KERNEL)
    gain = F.col("w") * F.greatest(kernel(F.col("d2")) - F.col("cover"), F.lit(0.0))
    return own.join(field, ["r", "c"]).groupBy("r0", "c0").agg(F.sum(gain).alias("gain")).select(F.col("r0").alias("r"), F.col("c0").alias("c"), "gain")


def budget_sweep(mask: DataFrame, base: DataFrame, spacings: list[int], truth: float, credit_solid: float) -> DataFrame:
    """(min_d2, dots, blind_credit, crowding, score) of a mask thinned to each squared spacing (1: not thinned).

    Blind credit is that of a base cell if truth were anywhere on the base; a spacing's credit is ``credit_solid``
    in proportion to it, and the score follows from it in closed form.
    """
    from .selection import random_spaced

    area = sum(max(1 - d**0.5 / 3, 0.0) for _, _, d in KERNEL)
    out = None
    for d2 in spacings:
        one = (mask.select("r", "c") if d2 <= 1 else random_spaced(mask, d2, 1)).select(F.lit(d2).alias("min_d2"), "r", "c")
        out = one if out is None else out.unionByName(one)
    got = blind_credit(out, base, "min_d2")
    solid = blind_credit(mask.select(F.lit(0).alias("_"), "r", "c"), base, "_").select(F.col("blind_credit").alias("_solid"))
    both = got.join(F.broadcast(solid), F.lit(True))
    crowding = F.col("dots") * F.lit(area) / (F.col("cells") * F.col("blind_credit"))
    credit = F.lit(credit_solid) * F.col("blind_credit") / F.col("_solid")
    return both.select("min_d2", "dots", F.round("blind_credit", 9).alias("blind_credit"), F.round(crowding, 6).alias("crowding"), F.round(forward_score(credit, F.col("dots"), crowding, F.lit(truth)), 9).alias("score"))
