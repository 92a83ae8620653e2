"""Surfaces made by tile and frequency filters, feature stacks, and boosted probabilities on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, neighbours as nb, surfaces
from ..operators.tiles import full_grid
from ..sources.cells import cells, mask, sites
from ..storage import stored
from .cell_queries import six
from .registry import CELL, query

SIDE = 256


def field(spark: SparkSession, d: str, *bands: str) -> DataFrame:
    """Bands of the cells on the whole grid, missing cells filled from the nearest one."""
    return stored(full_grid(stored(cells(spark, d).select("r", "c", *bands)), list(bands), SIDE, SIDE))


_G = "g AS (SELECT unnest(range(-4, 5)) i), k AS (SELECT i, exp(-0.5 * i * i) w FROM g), t AS (SELECT i, w / (SELECT sum(w) FROM k) g, -i * w / (SELECT sum(w) FROM k) d FROM k)"
_FULL = "cell2 AS (SELECT r, c, q FROM cell)"


@query("q_edge_magnitude", f"WITH {CELL}, {_FULL}, {_G}, p AS (SELECT r - i r, c, sum(q * g) s, sum(q * d) u FROM cell2, t GROUP BY 1, 2), x AS (SELECT r, c - i c, sum(s * d) gx, sum(u * g) gy FROM p, t GROUP BY 1, 2) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(sqrt(gx * gx + gy * gy), 6) AS edge FROM x SEMI JOIN cell USING (r, c)")
def edge_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.edge_magnitude(cells(spark, d).select("r", "c", "q"), "q", 1.0).select("r", "c", *six("edge"))


@query("q_box_stride", f"WITH {CELL}, o AS (SELECT unnest(range(-4, 5)) i), p AS (SELECT r + i r, c, sum(q) s FROM cell, o GROUP BY 1, 2), x AS (SELECT r, c + i c, sum(s) s FROM p, o GROUP BY 1, 2) SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, s AS total FROM x SEMI JOIN cell USING (r, c) WHERE r % 4 = 0 AND c % 4 = 0")
def box_stride(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.box_sum(cells(spark, d).select("r", "c", "q"), "q", 4, "total", 4)


@query("q_attenuation", f"""WITH {CELL}, s AS (SELECT a.r, a.c, a.q, CASE WHEN n.v IS NOT NULL AND p.v IS NOT NULL THEN (n.v - p.v) / 2 WHEN n.v IS NOT NULL THEN n.v - a.v WHEN p.v IS NOT NULL THEN a.v - p.v ELSE 0 END gy, CASE WHEN e.v IS NOT NULL AND w.v IS NOT NULL THEN (e.v - w.v) / 2 WHEN e.v IS NOT NULL THEN e.v - a.v WHEN w.v IS NOT NULL THEN a.v - w.v ELSE 0 END gx
 FROM cell a LEFT JOIN cell n ON n.r = a.r + 1 AND n.c = a.c LEFT JOIN cell p ON p.r = a.r - 1 AND p.c = a.c LEFT JOIN cell e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN cell w ON w.r = a.r AND w.c = a.c - 1), m AS (SELECT r, c, abs(q) a, sqrt(gy * gy + gx * gx) g FROM s)
 SELECT r, c, round(a / (SELECT quantile_cont(a, 0.99) FROM m WHERE a > 0) / (g / (SELECT quantile_cont(g, 0.99) FROM m WHERE g > 0) + 1e-6), 4) AS ratio FROM m""")
def attenuation(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.attenuation_ratio(stored(cells(spark, d).select("r", "c", "q", "v")), "q", "v").select("r", "c", F.round("ratio", 4).alias("ratio"))


@query("q_step_features")
def step_features(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.step_features(field(spark, d, "v", "q", "n"), "v", "q", "n", SIDE, SIDE)


@query("q_lineament")
def lineament(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.lineament_surface(cells(spark, d), "q", SIDE, SIDE, flat=True)


@query("q_phase_energy")
def phase_energy(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.phase_energy(cells(spark, d), "v", SIDE, SIDE)


@query("q_context")
def context(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.context_bands(field(spark, d, "v"), "v", SIDE, SIDE)


@query("q_depth_slices")
def depth_slices(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.depth_slices(field(spark, d, "v", "q"), "v", "q", SIDE, SIDE, (10.0, 20.0))


@query("q_magnetic")
def magnetic(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.magnetic_derivatives(field(spark, d, "v"), "v", SIDE, SIDE)


def solutions(spark: SparkSession, d: str) -> DataFrame:
    """Cells as point solutions with a depth, and the median depth of their 16 x 16 block as their cluster's."""
    x = cells(spark, d).where("q >= 40").select("r", "c", (F.col("v") % 4000).alias("depth"), F.floor(F.col("r") / 16).alias("br"), F.floor(F.col("c") / 16).alias("bc"))
    return x.join(x.groupBy("br", "bc").agg(F.avg("depth").alias("cluster_depth")), ["br", "bc"])


@query("q_cluster_maps")
def cluster_maps(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.cluster_maps(stored(solutions(spark, d)), cells(spark, d)).select("r", "c", *six("support", "shallow", "depth"))


def ridge_of(spark: SparkSession, lifted: DataFrame, name: str) -> DataFrame:
    return stored(surfaces.ridges(surfaces.gradient(lifted.select("r", "c", name), name), name).select("r", "c"))


@query("q_migration")
def migration(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    base = field(spark, d, "v")
    lifted = stored(surfaces.spectral(base, "v", SIDE, SIDE, 64, {"u1": lambda k: np.exp(-k * 2), "u2": lambda k: np.exp(-k * 4), "u3": lambda k: np.exp(-k * 6)}))
    normal = stored(surfaces.gradient(lifted.select("r", "c", "u2"), "u2"))
    levels = [ridge_of(spark, lifted, name) for name in ("u1", "u2", "u3")]
    return surfaces.migration_bands(levels, normal, "gy", "gx", SIDE)


def feature_stack(spark: SparkSession, d: str) -> DataFrame:
    """Cells with bands of several kinds side by side: raw, context, edges, slopes, distances, densities and blurred points."""
    from ..operators import composites

    x = stored(cells(spark, d))
    base = stored(full_grid(x.select("r", "c", "v", "q", "n"), ["v", "q", "n"], SIDE, SIDE))
    out = x.select("r", "c", "v", "q", "disc", "tax", F.col("n").cast("double").alias("n"))
    parts = [
        surfaces.context_bands(base, "v", SIDE, SIDE).withColumnsRenamed({k: f"v_{k}" for k in ("fine", "coarse", "slope", "coherence")}),
        surfaces.context_bands(base, "q", SIDE, SIDE).withColumnsRenamed({k: f"q_{k}" for k in ("fine", "coarse", "slope", "coherence")}),
        surfaces.step_features(base, "v", "q", "n", SIDE, SIDE),
        surfaces.edge_magnitude(base, "v", 2.0),
        surfaces.cluster_maps(stored(solutions(spark, d)), x),
        nb.design_matrix(x.select("r", "c"), mask(x, "flag = 'R'"), SIDE, SIDE, 4, 2).select("r", "c", *[F.col("features")[i].alias(n) for i, n in enumerate(("dist", "near", "y", "x"))]),
        composites.plume(sites(spark, d).select("r", "c", "temp"), x.select("r", "c"), "temp", 4.0),
    ]
    for part in parts:
        out = out.join(part, ["r", "c"], "left")
    return out


@query("q_feature_stack")
def stack(spark: SparkSession, d: str) -> DataFrame:
    return feature_stack(spark, d)


@query("q_calibrated_boosting")
def calibrated_boosting(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of a boosted fit on one half of the grid, its drawn negatives weighted back to their number."""
    x = cells(spark, d).select("r", "c", "v", "q", "disc", (F.col("flag") == "R").cast("int").alias("label"), (F.col("c") < 128).alias("train"))
    return models.prior_calibrated(stored(x), ["v", "q", "disc"], "label", "train", 5000).select("r", "c", "label", "prob")


@query("q_quadrant_surface")
def quadrant_surface(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of each quadrant from a bounded fit on the others."""
    fold = F.when(F.col("r") < 128, 0).otherwise(2) + F.when(F.col("c") < 128, 0).otherwise(1)
    x = cells(spark, d).select("r", "c", "v", "q", "disc", (F.col("flag") == "R").cast("int").alias("label"), fold.alias("fold"))
    return models.quadrant_surface(stored(x), ["v", "q", "disc"], "label", "fold", 4, 2000, 8000)

