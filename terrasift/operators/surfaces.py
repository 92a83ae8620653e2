"""Map algebra on cells: separable filters, gradients, ridges, boxes, spectra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored
from .neighbours import nearest, shift
from .statistics import quantile_cut, quantile_cuts, ranks, robust_scale, robust_unit
from .tiles import Tile, correlate, full_grid, grid_cells, slope, spectral, tiled


#: By sector of the slope's direction, the cells before and after across a ridge.
ACROSS = (((0, -1), (0, 1)), ((-1, 1), (1, -1)), ((-1, 0), (1, 0)), ((-1, -1), (1, 1)))


def gaussian_taps(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Normalised 1-D kernel of radius int(truncate * sigma + 0.5), or its first or second derivative."""
    k = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    total = sum(g)
    g = [x / total for x in g]
    if order == 1:
        return [-i / sigma**2 * x for i, x in zip(range(-k, k + 1), g, strict=True)]
    if order == 2:
        return [(i * i / sigma**4 - 1 / sigma**2) * x for i, x in zip(range(-k, k + 1), g, strict=True)]
    return g


def separable(cells: DataFrame, rows: list[float], cols: list[float], value: str, name: str, nearest_of: tuple[int, int] | None = None) -> DataFrame:
    """Adds the correlation with an outer product of two 1-D kernels, on tiles with a halo.

    Cells outside the table count as 0 in both passes; with ``nearest_of`` (height, width of a full grid) cells beyond
    the grid are as the nearest one of its edge.
    """
    reach = max(len(rows), len(cols)) // 2

    def solve(t: Tile) -> dict[str, np.ndarray]:
        first = correlate(t[value], rows, [1.0])
        return {name: correlate(first if nearest_of else np.where(t.inside, first, 0.0), [1.0], cols)}

    found = tiled(cells, [value], reach, solve, [name], nearest_of=nearest_of)
    return cells.join(found, ["r", "c"])


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """Adds gy, gx (central differences, one-sided at edges, 0 for a lone cell) and magnitude."""
    out = cells
    for axis, (dr, dc) in (("gy", (1, 0)), ("gx", (0, 1))):
        out = shift(shift(out, -dr, -dc, value, "_n", cells), dr, dc, value, "_p", cells)
        n, p, v = F.col("_n"), F.col("_p"), F.col(value)
        step = F.when(n.isNotNull() & p.isNotNull(), (n - p) / 2).when(n.isNotNull(), n - v).when(p.isNotNull(), v - p).otherwise(0.0)
        out = out.withColumn(axis, step).drop("_n", "_p")
    return out.withColumn("magnitude", F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")))


def ridges(cells: DataFrame, score: str, gy: str = "gy", gx: str = "gx") -> DataFrame:
    """Cells at least as high as one neighbour across the ridge and higher than the other.

    The gradient's direction falls in one of 4 sectors; a missing neighbour counts as lowest.
    """
    angle = F.pmod(F.degrees(F.atan2(F.col(gy), F.col(gx))) + 180, F.lit(180.0))
    sector = F.when((angle < 22.5) | (angle >= 157.5), 0).when(angle < 67.5, 1).when(angle < 112.5, 2).otherwise(3)
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    out = cells.withColumn("sector", sector)
    other = cells.select("r", "c", score)

    def side(sign: int, name: str) -> None:
        nonlocal out
        pick = lambda i: F.element_at(F.array(*[F.lit(sign * s[i]) for s in steps]), F.col("sector") + 1)
        at = out.withColumn("_r", F.col("r") + pick(0)).withColumn("_c", F.col("c") + pick(1))
        near = other.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(score).alias(name))
        out = at.join(near, ["_r", "_c"], "left").drop("_r", "_c")

    side(1, "_a")
    side(-1, "_b")
    low = F.lit(float("-inf"))
    a, b, v = F.coalesce("_a", low), F.coalesce("_b", low), F.col(score)
    return out.where(((v >= a) & (v > b)) | ((v > a) & (v >= b))).drop("_a", "_b")


def oriented_mean(cells: DataFrame, value: str, half: int, direction: str, name: str) -> DataFrame:
    """Mean along a line of 2 * half + 1 cells, missing ones as 0: a range window per line of the direction."""
    lines: dict[str, tuple[Column, Column]] = {
        "ns": (F.col("c"), F.col("r")),
        "ew": (F.col("r"), F.col("c")),
        "nwse": (F.col("r") - F.col("c"), F.col("r")),
        "nesw": (F.col("r") + F.col("c"), F.col("r")),
    }
    line, at = lines[direction]
    w = Window.partitionBy(line).orderBy(at).rangeBetween(-half, half)
    return cells.withColumn(name, F.sum(value).over(w) / (2 * half + 1))


def box_sum(cells: DataFrame, value: str, half: int, name: str, stride: int = 1) -> DataFrame:
    """Sum over a square about each cell whose row and column are multiples of ``stride``; missing cells are 0."""
    found = tiled(cells, [value], half, lambda t: {name: correlate(t[value], [1.0] * (2 * half + 1), [1.0] * (2 * half + 1))}, [name])
    return found.where((F.col("r") % stride == 0) & (F.col("c") % stride == 0))


def fill_nearest(cells: DataFrame, value: str, valid: Column, extent: int) -> DataFrame:
    """Invalid values become that of the nearest valid cell (ties by r, c); valid ones stay."""
    good = cells.where(valid).select("r", "c", F.col(value).alias("filled"))
    bad = nearest(cells.where(~F.coalesce(valid, F.lit(False))).select("r", "c"), good, extent)
    return good.unionByName(bad.select("r", "c", F.col("near.filled").alias("filled")))


def upward_continue(cells: DataFrame, value: str, height: int, width: int, lift: float, pad: int = 256) -> DataFrame:
    """(r, c, up): a full field as it would be ``lift`` cells higher, its edges reflected by ``pad`` cells."""
    return spectral(cells, value, height, width, pad, {"up": lambda k: np.exp(-k * lift)})


def depth_slices(cells: DataFrame, a: str, b: str, height: int, width: int, lifts: tuple[float, float], pad: int = 256) -> DataFrame:
    """(r, c, hg1, hg2, persist, tilt, other, rank): what a full field keeps of its edges when it is lifted.

    hg1, hg2: gradient magnitudes of ``a`` at both lifts; persist: hg2 over hg2 plus that of the smoothed surface
    field; tilt: angle of the vertical derivative at the first lift; other: hg2 of ``b``; rank: persist's place, 0 to 1.
    """
    low, high = lifts
    lifted = spectral(cells, a, height, width, pad, {"u1": lambda k: np.exp(-k * low), "u2": lambda k: np.exp(-k * high), "vz": lambda k: k * np.exp(-k * low)})
    other = spectral(cells, b, height, width, pad, {"ub": lambda k: np.exp(-k * high)})
    g = gaussian_taps(1.0)
    size = lambda t, x: np.hypot(*slope(x, t.inside))
    both = stored(cells.select("r", "c", a).join(lifted, ["r", "c"]).join(other, ["r", "c"]))

    def solve(t: Tile) -> dict[str, np.ndarray]:
        hg1, hg2, hg0 = size(t, t["u1"]), size(t, t["u2"]), size(t, correlate(t[a], g, g))
        return {"hg1": hg1, "hg2": hg2, "persist": hg2 / np.maximum(hg2 + hg0, 1e-300), "tilt": np.arctan2(t["vz"], hg1), "other": size(t, t["ub"])}

    bands = stored(tiled(both, [a, "u1", "u2", "vz", "ub"], len(g) // 2 + 1, solve, ["hg1", "hg2", "persist", "tilt", "other"], nearest_of=(height, width)))
    levels = ranks(bands, "persist", "_rank")
    return levels.join(F.broadcast(bands.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True)).withColumn("rank", (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_rank", "_n")


def magnetic_derivatives(cells: DataFrame, value: str, height: int, width: int, tile: int = 128, core: int = 64, least: float = 0.999, alpha: float = 0.25) -> DataFrame:
    """(r, c, gx, gy, gz): east and north differences and the downward derivative of a field, null where not covered.

    Differences need both neighbours. gz comes from tiles of ``tile`` cells under a Tukey window, whose central
    ``core`` cells are kept; tiles start every ``core`` cells, lie inside the grid, and count if ``least`` of their
    cells are there. Missing cells of a counted tile have the tile's mean and get no derivative.
    """
    margin = (tile - core) // 2
    x = np.linspace(0, 1, tile)
    window = np.where(np.minimum(x, 1 - x) < alpha / 2, 0.5 * (1 + np.cos(np.pi * (2 * np.minimum(x, 1 - x) / alpha - 1))), 1.0)
    taper = np.outer(window, window)
    k = np.hypot(2 * np.pi * np.fft.fftfreq(tile)[:, None], 2 * np.pi * np.fft.rfftfreq(tile)[None, :])
    of = lambda name, size: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(name) - tile + 1) / core)).cast("int"), F.least(F.floor(F.col(name) / core), F.lit((size - tile) // core)).cast("int")))
    fits = lambda name, size: F.ceil((F.col(name) - tile + 1) / core) <= (size - tile) // core
    homes = cells.where(F.col(value).isNotNull() & fits("r", height) & fits("c", width)).select("r", "c", F.col(value).cast("double").alias("v"), of("r", height).alias("i")).select("*", of("c", width).alias("j"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        if len(pdf) < math.ceil(least * tile * tile):
            return pd.DataFrame({"r": [], "c": [], "gz": []})
        r, c = pdf.r.to_numpy() - i * core, pdf.c.to_numpy() - j * core
        a = np.full((tile, tile), pdf.v.mean())
        a[r, c] = pdf.v.to_numpy()
        gz = np.fft.irfft2(np.fft.rfft2(a * taper) * k, s=(tile, tile))
        own = (r >= margin) & (r < margin + core) & (c >= margin) & (c < margin + core)
        return pd.DataFrame({"r": pdf.r[own], "c": pdf.c[own], "gz": gz[r[own], c[own]]})

    down = homes.groupBy("i", "j").applyInPandas(solve, "r int, c int, gz double")
    out = cells.select("r", "c", value)
    for name, dr, dc in (("_n", 1, 0), ("_s", -1, 0), ("_e", 0, 1), ("_w", 0, -1)):
        out = shift(out, -dr, -dc, value, name, cells)
    whole = F.col("_n").isNotNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull() & F.col("_w").isNotNull() & F.col(value).isNotNull()
    gx, gy = F.when(whole, (F.col("_e") - F.col("_w")) / 2), F.when(whole, -(F.col("_n") - F.col("_s")) / 2)
    return out.select("r", "c", gx.alias("gx"), gy.alias("gy")).join(down, ["r", "c"], "left")


def edge_magnitude(cells: DataFrame, value: str, sigma: float) -> DataFrame:
    """(r, c, edge): magnitude of the Gaussian gradient of a field, constant 0 outside."""
    g, d = gaussian_taps(sigma), gaussian_taps(sigma, 1)
    return tiled(cells, [value], len(g) // 2, lambda t: {"edge": np.hypot(correlate(t[value], d, g), correlate(t[value], g, d))}, ["edge"])


def step_features(cells: DataFrame, depth: str, conductance: str, strain: str, height: int, width: int, sigmas: tuple[float, float] = (3.0, 10.0)) -> DataFrame:
    """(r, c, depth_fine, depth_coarse, curvature, concordance, orientation, strain_step) of three fields on a full grid.

    Gradient magnitudes are smoothed and scaled between their 5 and 95 % quantiles. Concordance (the lesser of two)
    and orientation (cosine of the directions) are 0 unless both coarse gradients reach their 10 % quantile.
    """
    fine, coarse = (gaussian_taps(x) for x in sigmas)
    names = ["a1", "a2", "b2", "curve", "agree", "s2"]

    def solve(t: Tile) -> dict[str, np.ndarray]:
        a1 = np.hypot(*slope(correlate(t[depth], fine, fine), t.inside))
        smooth = correlate(t[depth], coarse, coarse)
        ay, ax = slope(smooth, t.inside)
        by, bx = slope(correlate(t[conductance], coarse, coarse), t.inside)
        a2, b2 = np.hypot(ay, ax), np.hypot(by, bx)
        around = sum(np.where(np.roll(t.inside, s, x), np.roll(smooth, s, x), smooth) for s in (1, -1) for x in (0, 1))
        agree = np.abs((ax * bx + ay * by) / np.maximum(a2 * b2, 1e-300))
        return {"a1": a1, "a2": a2, "b2": b2, "curve": np.abs(around - 4 * smooth), "agree": np.minimum(agree, 1.0), "s2": np.hypot(*slope(correlate(t[strain], coarse, coarse), t.inside))}

    raw = stored(tiled(cells, [depth, conductance, strain], len(coarse) // 2 + 2, solve, names, nearest_of=(height, width)))
    both = quantile_cut(quantile_cut(raw, "a2", 0.1, "_a"), "b2", 0.1, "_b")
    for old, new in (("a1", "depth_fine"), ("a2", "depth_coarse"), ("b2", "_other"), ("curve", "curvature"), ("s2", "strain_step")):
        both = robust_unit(both, old, 0.05, 0.95, new)
    strong = (F.col("a2") >= F.col("_a")) & (F.col("b2") >= F.col("_b"))
    return both.select("r", "c", "depth_fine", "depth_coarse", "curvature", F.when(strong, F.least("depth_coarse", "_other")).otherwise(0.0).alias("concordance"), F.when(strong, F.col("agree")).otherwise(0.0).alias("orientation"), "strain_step")


def lineament_surface(cells: DataFrame, value: str, height: int, width: int, half: int = 10, box: int = 3, flat: bool = False) -> DataFrame:
    """(r, c, field, score, bonus) of a ratio band (0, null: no data) on a grid: low ratios in lines.

    The band is scaled so that its 5 % quantile is 1 and its 95 % quantile 0, filled from the nearest cell with data,
    smoothed (reflected at the grid's edge), and thinned to ridges; a ridge scores the best mean of four directions
    ``half`` cells to either side (0 beyond the grid), more if it stands out of the other directions' mean. bonus is
    the largest score of a square around. Cells without data have 0. ValueError if the quantiles are equal, or there is no data; with ``flat`` such a band
    has no lines, and all three are 0.
    """
    known = cells.where(F.col(value) > 0).select("r", "c", F.col(value).cast("double").alias("_v"))
    cut = stored(quantile_cuts(known, "_v", {"_lo": 0.05, "_hi": 0.95}))
    ends = cut.select("_lo", "_hi").first()
    if ends is None or ends["_hi"] <= ends["_lo"]:
        if flat:
            return cells.select("r", "c", *[F.lit(0.0).alias(x) for x in ("field", "score", "bonus")])
        raise ValueError("the band has no data or no range between its 5 % and 95 % quantiles")
    some = cut.select("r", "c", F.least(F.greatest((F.col("_hi") - F.col("_v")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0)).alias("_f"))
    both = full_grid(some, ["_f"], height, width).join(some.select("r", "c", F.lit(1.0).alias("_known")), ["r", "c"], "left")
    g = gaussian_taps(1.0)

    def solve(t: Tile) -> dict[str, np.ndarray]:
        smooth = np.where(t.inside, correlate(t["_f"], g, g), 0.0)
        known = t.inside & (t["_known"] > 0)
        seen = np.where(known, smooth, 0.0)
        gy, gx = slope(seen, t.inside)
        sector = np.floor(((np.mod(np.arctan2(gy, gx), np.pi) + np.pi / 8) % np.pi) / (np.pi / 4)).astype(int)
        low = np.where(t.inside, seen, -np.inf)
        ridge = np.zeros(seen.shape, bool)
        means = []
        for k, (y, x) in enumerate(((0, 1), (-1, 1), (1, 0), (1, 1))):
            # at least as high as the cell before, higher than the one after, so that one of two equal cells is left
            p, n = (np.roll(low, (-a, -b), (0, 1)) for a, b in ACROSS[k])
            ridge |= (sector == k) & (low >= p) & (low > n)
            means.append(sum(np.roll(smooth, (i * y, i * x), (0, 1)) for i in range(-half, half + 1)) / (2 * half + 1))
        top, mean = np.max(means, 0), np.mean(means, 0)
        apart = np.where(top > 0, (top - mean) / np.maximum(top, 1e-12), 0.0)
        score = np.where(ridge & known & (seen > 0), np.clip(top, 0, 1) * (0.5 + 0.5 * apart), 0.0)
        bonus = np.max([np.roll(score, (y, x), (0, 1)) for y in range(-box, box + 1) for x in range(-box, box + 1)], 0)
        return {"field": seen, "score": score, "bonus": np.where(known, bonus, 0.0)}

    out = tiled(both, ["_f", "_known"], len(g) // 2 + half + box + 1, solve, ["field", "score", "bonus"], reflect_of=(height, width))
    return out.join(cells.select("r", "c"), ["r", "c"], "left_semi")


def phase_energy(cells: DataFrame, value: str, height: int, width: int, scales: tuple[float, ...] = (1.0, 2.0, 4.0, 7.0), angles: int = 8, fill: float = 7.0, background: float = 20.0) -> DataFrame:
    """(r, c, energy): where odd filter responses of all scales agree in phase, times the log of their strength.

    The band is filled by normalised smoothing, freed of its background, and divided by its median deviation (its
    standard deviation where that is 0). Filters reflect at the grid's edge.
    """
    wide, back = gaussian_taps(fill), gaussian_taps(background)

    def prepare(t: Tile) -> dict[str, np.ndarray]:
        known = t["_known"]
        filled = np.where(known > 0, t["_x"], correlate(t["_x"], wide, wide) / np.maximum(correlate(known, wide, wide), 1e-9))
        return {"hp": filled - correlate(filled, back, back)}

    v = F.col(value)
    known = F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e30), F.lit(False))
    own = cells.select("r", "c", F.when(known, v).otherwise(0.0).cast("double").alias("_x"), known.cast("double").alias("_known"), F.lit(1.0).alias("_own"))
    base = grid_cells(cells.sparkSession, height, width).join(own, ["r", "c"], "left").na.fill(0.0)
    edges = {"reflect_of": (height, width)}
    high = stored(tiled(base, ["_x", "_known"], len(wide) // 2 + len(back) // 2, prepare, ["hp"], **edges).join(base.select("r", "c", "_own"), ["r", "c"]))
    hp = stored(robust_scale(high, "hp", "_scale", F.col("_own") > 0).select("r", "c", "_own", (F.col("hp") / F.col("_scale")).alias("_z")))
    taps = [[gaussian_taps(s, k) for k in (0, 1, 2)] for s in scales]

    def solve(t: Tile) -> dict[str, np.ndarray]:
        z = t["_z"]
        parts = []
        for s, (g, d1, d2) in zip(scales, taps, strict=True):
            parts.append((s * correlate(z, d1, g), s * correlate(z, g, d1), s * s * correlate(z, d2, g), s * s * correlate(z, g, d2), s * s * correlate(z, d1, d1)))
        best, strength = np.zeros(z.shape), np.zeros(z.shape)
        for k in range(angles):
            c, n = np.cos(np.pi * k / angles), np.sin(np.pi * k / angles)
            odd = [c * gx + n * gy for gy, gx, _, _, _ in parts]
            even = [c * c * gxx + 2 * c * n * gxy + n * n * gyy for _, _, gyy, gxx, gxy in parts]
            amplitude = sum(np.hypot(o, e) for o, e in zip(odd, even, strict=True))
            flat, sharp = sum(map(np.abs, even)), sum(map(np.abs, odd))
            best = np.maximum(best, np.abs(sum(odd)) / (amplitude + 1e-6) * (sharp / (sharp + flat + 1e-6)))
            strength = np.maximum(strength, amplitude)
        return {"phase": best, "strength": strength}

    found = tiled(hp, ["_z"], max(len(x[0]) for x in taps) // 2, solve, ["phase", "strength"], **edges)
    inside = stored(found.join(hp.where("_own > 0").select("r", "c"), ["r", "c"], "left_semi"))
    return robust_scale(inside, "strength", "_e").select("r", "c", (F.col("phase") * F.log1p(F.col("strength") / F.col("_e"))).alias("energy"))


def context_bands(cells: DataFrame, value: str, height: int, width: int, fine: float = 2.0, coarse: float = 5.0) -> DataFrame:
    """(r, c, fine, coarse, slope, coherence) of a full field scaled by its median and quartiles (to 30 either way).

    coherence compares the eigenvalues of the smoothed structure tensor: 1 along one direction, 0 without any.
    """
    q = quantile_cuts(cells, value, {"_m": 0.5, "_lo": 0.25, "_hi": 0.75})
    scaled = (F.col(value) - F.col("_m")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    z = stored(q.select("r", "c", F.least(F.greatest(scaled, F.lit(-30.0)), F.lit(30.0)).alias("_z")))
    a, b = gaussian_taps(fine), gaussian_taps(coarse)

    def solve(t: Tile) -> dict[str, np.ndarray]:
        low, wide = correlate(t["_z"], a, a), correlate(t["_z"], b, b)
        gy, gx = slope(low, t.inside)
        yy, xx, xy = (correlate(np.where(t.inside, p, 0.0), b, b) for p in (gy * gy, gx * gx, gy * gx))
        return {"fine": low, "coarse": wide, "slope": np.hypot(gy, gx), "coherence": np.sqrt((xx - yy) ** 2 + 4 * xy**2) / np.maximum(xx + yy, 1e-12)}

    return tiled(z, ["_z"], len(a) // 2 + len(b) // 2 + 1, solve, ["fine", "coarse", "slope", "coherence"], nearest_of=(height, width))


def cluster_maps(points: DataFrame, cells: DataFrame, sigma: float = 2.0, most_depth: float = 3000.0) -> DataFrame:
    """(r, c, support, shallow, depth) in 0..1 from solutions (r, c, depth, cluster_depth): scattered, smoothed, logged."""
    at = points.groupBy("r", "c").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.least(F.greatest(1 - F.col("depth") / most_depth, F.lit(0.0)), F.lit(1.0))).alias("_s"), F.sum(F.col("cluster_depth") / 1000).alias("_d"))
    base = cells.select("r", "c").join(at, ["r", "c"], "left").na.fill(0.0, ["_n", "_s", "_d"])
    g = gaussian_taps(sigma)

    def solve(t: Tile) -> dict[str, np.ndarray]:
        n, s, d = (correlate(t[k], g, g) for k in ("_n", "_s", "_d"))
        unit = lambda x: np.clip(np.log1p(x) / np.log1p(5.0), 0, 1)
        return {"support": unit(n), "shallow": unit(s), "depth": np.clip(np.where(n > 1e-12, d / np.maximum(n, 1e-300) / 3.0, 0.0), 0, 1)}

    return tiled(base, ["_n", "_s", "_d"], len(g) // 2, solve, ["support", "shallow", "depth"])


def attenuation_ratio(cells: DataFrame, shallow: str, deep: str) -> DataFrame:
    """(r, c, ratio): a band's magnitude over the gradient of its lifted field, each by its 99 % quantile of positive values."""
    slopes = gradient(cells.select("r", "c", shallow, deep), deep).withColumn("_a", F.abs(F.col(shallow)))
    top = lambda name: F.broadcast(quantile_cut(slopes.where(F.col(name) > 0).select(name), name, 0.99, "_q").agg(F.max("_q").alias(f"_q{name}")))
    both = slopes.join(top("_a"), F.lit(True)).join(top("magnitude"), F.lit(True))
    a = F.col("_a") / F.greatest(F.coalesce("_q_a", F.lit(1.0)), F.lit(1e-12))
    b = F.col("magnitude") / F.greatest(F.coalesce("_qmagnitude", F.lit(1.0)), F.lit(1e-12))
    return both.select("r", "c", (a / (b + 1e-6)).alias("ratio"))


def migration_bands(levels: list[DataFrame], cells: DataFrame, gy: str, gx: str, extent: int, most: float = 10.0) -> DataFrame:
    """(r, c, vy, vx, signed, coherence): how ridges move from the shallowest to the deepest of several levels.

    levels: ridge cells (r, c) of each level, shallow to deep; cells: the grid with a normal (gy, gx). A shallow
    ridge cell's step leads to the nearest deep one; steps and their share along the normal are cut at ``most``,
    smoothed where ridges are dense enough, and 0 elsewhere. coherence is the mean of exp(-distance / 2) to all levels.
    """
    steps = nearest(levels[0].select("r", "c"), levels[-1].select("r", "c"), extent).join(cells.select("r", "c", gy, gx), ["r", "c"])
    y, x = (F.col("near.r") - F.col("r")).cast("double"), (F.col("near.c") - F.col("c")).cast("double")
    size, norm = F.sqrt(y * y + x * x), F.sqrt(F.col(gy) * F.col(gy) + F.col(gx) * F.col(gx))
    part = F.when(size > most, most / size).otherwise(1.0)
    along = F.when(norm > 0, (y * F.col(gy) + x * F.col(gx)) / norm).otherwise(0.0)
    sparse = steps.select("r", "c", (y * part).alias("_y"), (x * part).alias("_x"), F.least(F.greatest(along, F.lit(-most)), F.lit(most)).alias("_s"), F.lit(1.0).alias("_w"))
    base = cells.select("r", "c").join(sparse, ["r", "c"], "left").na.fill(0.0)
    g = gaussian_taps(2.0)

    def solve(t: Tile) -> dict[str, np.ndarray]:
        w = correlate(t["_w"], g, g)
        vy, vx, signed = (np.where(w > 0.05, correlate(t[k], g, g) / np.maximum(w, 1e-12), 0.0) for k in ("_y", "_x", "_s"))
        return {"vy": vy, "vx": vx, "signed": np.clip(signed, -most, most)}

    out = tiled(base, ["_y", "_x", "_s", "_w"], len(g) // 2, solve, ["vy", "vx", "signed"])
    near = None
    for i, level in enumerate(levels):
        one = nearest(cells.select("r", "c"), level.select("r", "c"), extent).select("r", "c", F.exp(-F.sqrt("d2") / 2).alias(f"_{i}"))
        near = one if near is None else near.join(one, ["r", "c"])
    mean = sum((F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(levels))), F.lit(0.0)) / len(levels)
    return out.join(near.select("r", "c", mean.alias("coherence")), ["r", "c"])


def skeleton(mask: DataFrame, steps: int = 16) -> DataFrame:
    """Zhang-Suen thinning to lines one cell wide: both half-passes until neither takes a cell.

    A round takes ``steps`` times both half-passes in tiles whose halo is as wide as these reach, so that a solid
    shape costs rounds by a fraction of its width.
    """
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    n, e, s, w = 0, 2, 4, 6
    cut = (((n, e, s), (e, s, w)), ((n, e, w), (n, s, w)))

    def thin(t: Tile) -> dict[str, np.ndarray]:
        on = np.pad(t["_on"] > 0, 1)
        for _ in range(steps):
            before = on.sum()
            for a, b in cut:
                # beyond the tile's halo nothing is known: what that spoils moves in a cell a half-pass and stays in the halo
                near = [np.roll(on, (-y, -x), (0, 1)) for y, x in around]
                count = sum(k.astype(np.int8) for k in near)
                rises = sum((~k & near[(i + 1) % 8]).astype(np.int8) for i, k in enumerate(near))
                gone = on & (count >= 2) & (count <= 6) & (rises == 1) & ~(near[a[0]] & near[a[1]] & near[a[2]]) & ~(near[b[0]] & near[b[1]] & near[b[2]])
                gone[0], gone[-1], gone[:, 0], gone[:, -1] = False, False, False, False
                on = on & ~gone
            if on.sum() == before:
                break
        return {"_on": on[1:-1, 1:-1].astype(float)}

    now, before = stored(mask.select("r", "c").distinct()), None
    while before != (before := now.count()):
        last, now = now, stored(tiled(now.withColumn("_on", F.lit(1.0)), ["_on"], 2 * steps, thin, ["_on"]).where("_on > 0").select("r", "c"))
        forget(last)
    return now
