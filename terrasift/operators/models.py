"""Boosted probabilities out of fold, least squares, and non-negative mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .neighbours import offsets, spread


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, negatives: int = 10, seed: int = 2026, trees: int = 10, buffer: int = 6) -> DataFrame:
    """Adds ``prob``, from boosted trees fitted without the row's own fold and without cells within ``buffer`` of it.

    Neighbours of a fold's cells say too much of them: training cells keep farther away than the buffer. Missing
    values are filled by the median and marked by a flag. At most ``negatives`` negatives per positive enter a fit,
    drawn by hash.
    """
    own = df.select("r", "c", fold).distinct()
    # a training cell near a held fold: found by one spread of all cells, kept as the list of folds it is too near to
    near = spread(own.withColumnRenamed(fold, "_held"), offsets(buffer * buffer)).join(own, ["r", "c"]).where(F.col("_held") != F.col(fold)).groupBy("r", "c").agg(F.collect_set("_held").alias("_near"))
    ready = stored(df.join(near, ["r", "c"], "left"))
    far = lambda k: ~F.coalesce(F.array_contains("_near", k), F.lit(False))
    return _by_fold(ready, df.columns, features, label, fold, folds, negatives, seed, trees, far)


def _ready(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``_x``: features, missing values as the median (0 where a feature has no value at all), and flags of these."""
    ready = df.select("*", *[F.col(f).isNull().cast("double").alias(f"{f}_missing") for f in features])
    filled = [f"{f}_filled" for f in features]
    known = ready.agg(*[F.count(F.when(~F.isnan(F.col(f).cast("double")), F.col(f))).alias(f) for f in features]).first()
    some = [f for f in features if known[f]]
    if some:
        ready = Imputer(strategy="median", inputCols=some, outputCols=[f"{f}_filled" for f in some]).fit(ready).transform(ready)
    ready = ready.select("*", *[F.lit(0.0).alias(f"{f}_filled") for f in features if f not in some])
    ready = VectorAssembler(inputCols=filled + [f"{f}_missing" for f in features], outputCol="_x").transform(ready)
    return ready


def _one_sided(rows: DataFrame, p: float, n: float) -> DataFrame:
    """Adds ``prob`` where there is nothing to tell apart: the share of positives, null without training rows."""
    return rows.withColumn("prob", F.lit(float(p) / float(p + n) if p + n else None).cast("double"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "r", "c")


def _share(share: float) -> Column:
    """Bound on a 64-bit hash that so much of the rows stays below."""
    return F.lit((1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63))


def _by_fold(df: DataFrame, columns: list[str], features: list[str], label: str, fold: str, folds: int, negatives: int, seed: int, trees: int, far) -> DataFrame:
    ready = _ready(df, features)
    out = None
    for k in range(folds):
        train = ready.where((F.col(fold) != k) & far(k))
        p, n = train.agg(F.coalesce(F.sum(label), F.lit(0)), F.coalesce(F.sum(1 - F.col(label)), F.lit(0))).first()
        drawn = train.where((F.col(label) == 1) | (_hash(seed) <= _share(min(1.0, negatives * p / max(n, 1)))))
        held = ready.where(F.col(fold) == k)
        if p and n:
            part = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=3, seed=seed).fit(drawn).transform(held).withColumn("prob", vector_to_array("probability")[1])
        else:
            part = _one_sided(held, p, n)
        part = part.select(*columns, "prob")
        out = part if out is None else out.unionByName(part)
    return out


def prior_calibrated(df: DataFrame, features: list[str], label: str, train: str, max_negatives: int, seed: int = 2026, trees: int = 10) -> DataFrame:
    """Adds ``prob`` to all rows, from boosted trees fitted to the rows marked ``train``.

    About ``max_negatives`` negatives enter the fit, drawn by hash and weighted back to their number, so that
    probabilities keep the share of positives; without positives or negatives to learn from, they are that share.
    """
    ready = _ready(df, features)
    known = ready.where(train)
    p, n = known.agg(F.coalesce(F.sum(label), F.lit(0)), F.coalesce(F.sum(1 - F.col(label)), F.lit(0))).first()
    if not p or not n:
        return _one_sided(ready, p, n).select(*df.columns, "prob")
    some = known.where((F.col(label) == 1) | (_hash(seed) <= _share(max_negatives / n)))
    kept = some.where(F.col(label) == 0).count()
    weighted = some.withColumn("_weight", F.when(F.col(label) == 1, 1.0).otherwise(n / max(kept, 1)))
    model = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=3, seed=seed).fit(weighted)
    return model.transform(ready).withColumn("prob", vector_to_array("probability")[1]).select(*df.columns, "prob")


def quadrant_surface(df: DataFrame, features: list[str], label: str, fold: str, folds: int, max_positives: int, max_rows: int, seed: int = 2026, trees: int = 10) -> DataFrame:
    """Adds ``prob``: each fold from a fit on the others, on about ``max_positives`` positives and ``max_rows`` rows in all, drawn by hash.

    Where the others lack positives or negatives, the share of positives.
    """
    ready, out = _ready(df, features), None
    for k in range(folds):
        known = ready.where(F.col(fold) != k)
        p, n = known.agg(F.coalesce(F.sum(label), F.lit(0)), F.coalesce(F.sum(1 - F.col(label)), F.lit(0))).first()
        good = min(p, max_positives)
        share = F.when(F.col(label) == 1, _share(max_positives / max(p, 1))).otherwise(_share((max_rows - good) / max(n, 1)))
        held = ready.where(F.col(fold) == k)
        if p and n:
            model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=3, seed=seed).fit(known.where(_hash(seed) <= share))
            part = model.transform(held).withColumn("prob", vector_to_array("probability")[1])
        else:
            part = _one_sided(held, p, n)
        part = part.select(*df.columns, "prob")
        out = part if out is None else out.unionByName(part)
    return out


def loo_r2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and leave-one-out R2 of a line, from sums alone (residual / (1 - leverage))."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    both = df.join(F.broadcast(s), F.lit(True))
    res = F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    lever = 1 / F.col("n") + F.pow(F.col(x) - F.col("mx"), 2) / (F.col("n") * F.col("vx"))
    loo_mean = F.pow((F.col(y) - F.col("my")) * F.col("n") / (F.col("n") - 1), 2)
    return both.agg(F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), (1 - F.sum(res * res) / F.sum(F.pow(F.col(y) - F.col("my"), 2))).alias("r2"), (1 - F.sum(F.pow(res / (1 - lever), 2)) / F.sum(loo_mean)).alias("loo_r2"))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """Active-set solution of min |a x - b|, x >= 0, for the small systems that aggregates leave."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max(initial=-np.inf) <= 1e-10:
            break
        free[np.flatnonzero(~free)[np.argmax(w[~free])]] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min(initial=np.inf) > 0:
                x = z
                break
            low = free & (z <= 0)
            t = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + t * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x
