"""Surfaces and joins made of several operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import nonnegative_least_squares
from .neighbours import offsets, spread
from .surfaces import gaussian_taps, separable


def nematic_order(parts: list[tuple[Column, Column]]) -> Column:
    """|sum of w * exp(2 i angle)| / sum of w over (weight, angle in degrees); 0 without weight."""
    total = sum((w for w, _ in parts), F.lit(0.0))
    x = sum((w * F.cos(F.radians(2 * a)) for w, a in parts), F.lit(0.0))
    y = sum((w * F.sin(F.radians(2 * a)) for w, a in parts), F.lit(0.0))
    return F.when(total > 0, F.sqrt(x * x + y * y) / total).otherwise(0.0)


def plume(points: DataFrame, cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """Largest value per cell, blurred, scaled to its own maximum; cells without points start at 0."""
    top = points.groupBy("r", "c").agg(F.greatest(F.max(value), F.lit(0.0)).alias("_t"))
    field = cells.join(top, ["r", "c"], "left").select("r", "c", F.coalesce("_t", F.lit(0.0)).alias("_t"))
    g = gaussian_taps(sigma)
    smooth = separable(field, g, g, "_t", "_s").select("r", "c", "_s")
    most = smooth.agg(F.max("_s").alias("_m"))
    return smooth.join(F.broadcast(most), F.lit(True)).select("r", "c", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(0.0).alias("plume"))


def extrapolate(shallow: DataFrame, deep: DataFrame, most_d2: int, least_d2: int) -> DataFrame:
    """2 * shallow - deep for each deep cell and its nearest shallow one (ties by r, c), within the bounds."""
    near = spread(shallow.select("r", "c", F.col("r").alias("ar"), F.col("c").alias("ac")), offsets(most_d2))
    best = near.join(deep.select("r", "c"), ["r", "c"]).groupBy("r", "c").agg(F.min(F.struct("d2", "ar", "ac")).alias("k")).where(F.col("k.d2") >= least_d2)
    return best.select((2 * F.col("k.ar") - F.col("r")).alias("r"), (2 * F.col("k.ac") - F.col("c")).alias("c")).distinct()


def mixture(df: DataFrame, row: str, part: str, value: str) -> DataFrame:
    """(part, weight): non-negative weights of parts' counts that explain sums of ``value`` by row.

    The matrix is an aggregate of rows by parts, both few; only it comes to the driver.
    """
    table = df.groupBy(row, part).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).orderBy(row, part).collect()
    rows, parts = sorted({t[0] for t in table}), sorted({t[1] for t in table})
    a, b = np.zeros((len(rows), len(parts))), np.zeros(len(rows))
    for r, p, n, v in table:
        a[rows.index(r), parts.index(p)] = n
        b[rows.index(r)] += v
    weights = nonnegative_least_squares(a, b) if table else []
    return df.sparkSession.createDataFrame([(p, round(float(w), 4)) for p, w in zip(parts, weights, strict=True)], "part string, weight double")
