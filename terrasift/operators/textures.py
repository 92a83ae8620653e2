"""Surfaces that compare sides, scales and windows: texture boundaries, potential edges, vesselness, Euler windows, pair counts.

Each is one or two passes over tiles; what is global (quantiles, largest norms) is an aggregate between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .statistics import quantile_cut, quantile_cuts, robust_scale, robust_unit
from .surfaces import gaussian_taps
from .tiles import Tile, correlate, full_grid, grid_cells, slope, tiled

#: Row and column steps along the normal and along the boundary, for four directions of a boundary.
SIDES = ((0, 1, -1, 0), (1, 1, -1, 1), (1, 0, 0, 1), (1, -1, 1, 1))


def _correlation(middle: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Product of two samples along a side over their variance, the side's own mean taken off."""
    mean = (middle + before + after) / 3
    a, b = before - mean, after - mean
    return a * b / ((a * a + b * b + (middle - mean) ** 2) / 3 + 1e-6)


def texture_boundary(cells: DataFrame, bands: list[str], height: int, width: int, scales: tuple[int, ...] = (2, 4, 8), fill: float = 3.0) -> DataFrame:
    """(r, c, each band's surface, boundary): where the texture along a line differs from one side to the other.

    A band is filled by normalised smoothing where it is null or NaN, and freed of its median and median deviation.
    At each scale the three samples along either side, that far out and that far apart, give a correlation; a
    direction's change is the mean over scales of how much the two differ, 0 where any sample lies outside the
    cells; a band's surface is the largest of four directions, at most 2. Surfaces are scaled by their 99 % quantile
    and fused by their geometric mean.
    """
    g = gaussian_taps(fill)

    def fill_in(t: Tile) -> dict[str, np.ndarray]:
        out = {}
        for i in range(len(bands)):
            x, known = t[f"_x{i}"], t[f"_k{i}"]
            out[f"_f{i}"] = np.where(known > 0, x, correlate(x, g, g) / np.maximum(correlate(known, g, g), 1e-6))
        return out

    good = [F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")) for b in bands]
    base = cells.select("r", "c", *[F.when(k, F.col(b)).otherwise(0.0).cast("double").alias(f"_x{i}") for i, (b, k) in enumerate(zip(bands, good, strict=True))], *[k.cast("double").alias(f"_k{i}") for i, k in enumerate(good)])
    names = [f"_f{i}" for i in range(len(bands))]
    filled = stored(tiled(base, [f"_{k}{i}" for k in "xk" for i in range(len(bands))], len(g) // 2, fill_in, names, nearest_of=(height, width)))
    for n in names:
        filled = stored(robust_scale(filled, n, "_s").withColumn(n, (F.col(n) - F.col("_s_at")) / F.col("_s")).drop("_s", "_s_at"))

    def sides(t: Tile) -> dict[str, np.ndarray]:
        out = {}
        for b, n in zip(bands, names, strict=True):
            z = np.where(t.inside, t[n], np.nan)
            at = lambda y, x: np.roll(z, (int(y), int(x)), (0, 1))  # noqa: B023, E731
            best = np.zeros(z.shape)
            for ny, nx, ty, tx in SIDES:
                change = np.zeros(z.shape)
                for k in scales:
                    y, x, v, u = ny * k, nx * k, ty * k, tx * k
                    one = _correlation(at(y, x), at(y - v, x - u), at(y + v, x + u))
                    other = _correlation(at(-y, -x), at(-y - v, -x - u), at(-y + v, -x + u))
                    change = change + np.abs(one - other) / len(scales)
                best = np.fmax(best, np.nan_to_num(change, nan=0.0))
            out[b] = np.clip(best, 0, 2)
        return out

    found = stored(tiled(filled, names, 2 * max(scales), sides, bands))
    cut = found
    for i, b in enumerate(bands):
        cut = quantile_cut(cut, b, 0.99, f"_top{i}")
    unit = [F.least(F.col(b) / F.when(F.col(f"_top{i}") > 0, F.col(f"_top{i}")).otherwise(1.0), F.lit(1.0)) for i, b in enumerate(bands)]
    product = unit[0]
    for u in unit[1:]:
        product = product * u
    return cut.select("r", "c", *bands, F.pow(product, F.lit(1.0 / len(bands))).alias("boundary"))


def potential_edges(cells: DataFrame, a: str, b: str, height: int, width: int, sigmas: tuple[float, ...] = (3.0, 10.0), cell: float = 1.0) -> DataFrame:
    """(r, c, a_0.., b_0.., concordance, orientation) of the cells where both fields are known.

    Both are filled from the nearest such cell, smoothed at each scale, and their gradient magnitudes scaled between
    their 5 and 95 % quantiles. Concordance (the lesser of both at the last scale) and orientation (cosine between
    the gradients' lines) are 0 unless both gradients reach their own 10 % quantile there.
    """
    known = stored(cells.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))).select("r", "c", F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")))
    grid = full_grid(known, ["_a", "_b"], height, width)
    taps = [gaussian_taps(s) for s in sigmas]
    names = [f"{k}_{i}" for k in ("a", "b") for i in range(len(sigmas))]

    def solve(t: Tile) -> dict[str, np.ndarray]:
        out, last = {}, []
        for k in ("a", "b"):
            for i, g in enumerate(taps):
                gy, gx = (d / cell for d in slope(correlate(t[f"_{k}"], g, g), t.inside))
                out[f"{k}_{i}"] = np.hypot(gy, gx)
            last.append((gy, gx))
        (ay, ax), (by, bx) = last
        out["cosine"] = np.minimum(np.abs(ay * by + ax * bx) / np.maximum(np.hypot(ay, ax) * np.hypot(by, bx), 1e-300), 1.0)
        return out

    raw = tiled(grid, ["_a", "_b"], len(taps[-1]) // 2 + 2, solve, [*names, "cosine"], nearest_of=(height, width))
    out = stored(raw.join(known.select("r", "c"), ["r", "c"], "left_semi"))
    a_last, b_last = f"a_{len(sigmas) - 1}", f"b_{len(sigmas) - 1}"
    out = quantile_cut(quantile_cut(out, a_last, 0.1, "_a"), b_last, 0.1, "_b").withColumn("_strong", (F.col(a_last) >= F.col("_a")) & (F.col(b_last) >= F.col("_b")))
    for n in names:
        out = robust_unit(out, n, 0.05, 0.95, f"_u_{n}").drop(n).withColumnRenamed(f"_u_{n}", n)
    return out.select("r", "c", *names, F.when(F.col("_strong"), F.least(a_last, b_last)).otherwise(0.0).alias("concordance"), F.when(F.col("_strong"), F.col("cosine")).otherwise(0.0).alias("orientation"))


def vesselness(cells: DataFrame, value: str, height: int, width: int, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0), beta: float = 0.5) -> DataFrame:
    """(r, c, vesselness, scale) of bright ridges: the largest over scales, and the scale that gave it.

    The field is filled from the nearest known cell; second derivatives are normalised by the scale. A scale's norms
    are measured against half the largest of them over the known cells. A constant field has none. Cells whose value
    is null or NaN are left out.
    """
    known = stored(cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("r", "c", F.col(value).cast("double").alias("_v")))
    taps = [[gaussian_taps(s, k) for k in (0, 1, 2)] for s in sigmas]
    names = [f"{k}{i}" for k in ("blob", "norm") for i in range(len(sigmas))]

    def solve(t: Tile) -> dict[str, np.ndarray]:
        out = {}
        for i, (s, (g, d1, d2)) in enumerate(zip(sigmas, taps, strict=True)):
            xx, yy, xy = (s * s * correlate(t["_v"], *k) for k in ((g, d2), (d2, g), (d1, d1)))
            root = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
            p, q = (xx + yy + root) / 2, (xx + yy - root) / 2
            small, large = np.where(np.abs(p) > np.abs(q), q, p), np.where(np.abs(p) > np.abs(q), p, q)
            ratio = np.abs(small) / np.maximum(np.abs(large), np.finfo(float).tiny)
            out[f"blob{i}"] = np.where(large < 0, np.exp(-(ratio**2) / (2 * beta * beta)), 0.0)
            out[f"norm{i}"] = np.hypot(small, large)
        return out

    reach = max(len(k[0]) for k in taps) // 2
    raw = tiled(full_grid(known, ["_v"], height, width), ["_v"], reach, solve, names, nearest_of=(height, width))
    raw = stored(raw.join(known.select("r", "c"), ["r", "c"], "left_semi"))
    most = raw.agg(*[(F.max(f"norm{i}") / 2).alias(f"_c{i}") for i in range(len(sigmas))])
    flat = known.agg((F.max("_v") == F.min("_v")).alias("_flat"), (1e-12 * (F.max(F.abs("_v")) + 1)).alias("_least"))
    both = raw.join(F.broadcast(most), F.lit(True)).join(F.broadcast(flat), F.lit(True))
    each = []
    for i, s in enumerate(sigmas):
        n, c = F.col(f"norm{i}"), F.col(f"_c{i}")
        v = F.when(~F.col("_flat") & (c > F.col("_least")), F.col(f"blob{i}") * (1 - F.exp(-n * n / (2 * c * c)))).otherwise(0.0)
        each.append(F.struct(v.alias("v"), F.lit(-s).alias("s")))
    best = F.array_max(F.array(*each))
    return both.select("r", "c", best["v"].alias("vesselness"), F.when(best["v"] > 0, -best["s"]).alias("scale"))


def _box(a: np.ndarray, size: int) -> np.ndarray:
    """Sum of the square of ``size`` cells that begins at each cell, by running sums; 0 where it does not fit."""
    sums = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    sums[1:, 1:] = a.cumsum(0).cumsum(1)
    out = np.zeros(a.shape)
    out[: 1 - size or None, : 1 - size or None] = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
    return out


#: What a window's solution passed, in order; each row says how far it came.
EULER_GATES = ("condition", "depth", "uncertainty", "place")


def euler_windows(cells: DataFrame, index: float, window: int = 10, stride: int = 4, most_condition: float = 1e5, most_error: float = 0.15, depth: tuple[float, float] = (1.0, 30.0), tolerance: float = 2.0) -> DataFrame:
    """Euler deconvolution of every window of ``window`` cells squared that begins at a multiple of ``stride``.

    cells: r, c, t (field), gy, gx, gz (its gradients by row, column, downwards); only windows all of whose cells have
    all four are solved. Returns (r, c) of the window's first cell, the source's row, col and depth in cells, offset,
    condition (of the normalised system), error (the depth's standard error over its size), rms, and passed: how
    many of ``EULER_GATES`` it passed, in their order. Windows whose system is singular have only passed = 0. Each
    sum of the normal equations comes from running sums within a tile, so a cell is read once, whatever the window.
    """
    bands = ["t", "gy", "gx", "gz"]
    good = F.lit(True)
    for b in bands:
        good = good & F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double"))
    names = ["row", "col", "depth", "offset", "condition", "error", "rms", "passed"]
    n = window * window

    def solve(t: Tile) -> dict[str, np.ndarray]:
        out = {k: np.full(t.inside.shape, np.nan) for k in names}
        y, x = (i.astype(float) for i in np.indices(t.inside.shape))
        y0, x0 = y.mean(), x.mean()
        g = [t["gy"], t["gx"], t["gz"], t.inside.astype(float)]
        right = (y - y0) * g[0] + (x - x0) * g[1] + index * t["t"]
        whole = np.round(_box(g[3], window)) == n
        r, c = np.nonzero(whole & ((np.arange(len(y)) + t.r0) % stride == 0)[:, None] & ((np.arange(y.shape[1]) + t.c0) % stride == 0)[None, :])
        if not len(r):
            return out
        out["passed"][r, c] = 0
        a = np.empty((len(r), 4, 4))
        for i in range(4):
            for j in range(i, 4):
                a[:, i, j] = a[:, j, i] = _box(g[i] * g[j], window)[r, c]
        b = np.stack([_box(k * right, window)[r, c] for k in g], 1)
        norm = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-30))
        unit = a / norm[:, :, None] / norm[:, None, :]
        size = np.linalg.eigvalsh(unit)
        ok = size[:, 0] > 1e-12
        condition = np.sqrt(size[ok, 3] / size[ok, 0])
        r, c, a, b, norm, unit = r[ok], c[ok], a[ok], b[ok], norm[ok], unit[ok]
        s = np.linalg.solve(unit, (b / norm)[:, :, None])[:, :, 0] / norm
        left = np.maximum(_box(right * right, window)[r, c] - np.einsum("ki,ki->k", s, b), 0.0)
        spread = np.sqrt(np.maximum(left / max(n - 4, 1) * np.linalg.inv(unit)[:, 2, 2], 0.0)) / norm[:, 2]
        error = spread / np.maximum(np.abs(s[:, 2]), 1e-12)
        row, col = s[:, 0] + y0, s[:, 1] + x0
        near = (row >= r - tolerance) & (row <= r + window - 1 + tolerance) & (col >= c - tolerance) & (col <= c + window - 1 + tolerance)
        gates = np.stack([condition <= most_condition, (s[:, 2] >= depth[0]) & (s[:, 2] <= depth[1]), error <= most_error, near])
        for k, v in {"row": row + t.r0, "col": col + t.c0, "depth": s[:, 2], "offset": s[:, 3], "condition": condition, "error": error, "rms": np.sqrt(left / n), "passed": np.cumprod(gates, 0).sum(0)}.items():
            out[k][r, c] = v
        return out

    found = tiled(cells.where(good).select("r", "c", *bands), bands, window, solve, names)
    return found.where("passed >= 0 and not isnan(passed)").select("r", "c", *names[:-1], F.col("passed").cast("int").alias("passed"))


def pair_counts(mask: DataFrame, radii: list[int]) -> DataFrame:
    """(radius, pairs): how many pairs of different cells of a mask lie within each radius.

    A tile's own cells are correlated with those of the tile and its halo by fast transforms, so the work depends on
    the tile's size and not on how many pairs there are; a tile gives one number a radius.
    """
    radii = sorted(radii)
    reach = radii[-1]
    tile = max(128, 2 * reach)
    near = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / tile).cast("int"), F.floor((F.col(x) + reach) / tile).cast("int")))
    homes = mask.select("r", "c").distinct().select("*", near("r").alias("tr")).select("*", near("c").alias("tc"))
    n = tile + 2 * reach
    at = np.fft.fftfreq(n, 1 / n)
    d2 = np.round(at[:, None] ** 2 + at[None, :] ** 2)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf.r.to_numpy() - pdf.tr.iloc[0] * tile + reach, pdf.c.to_numpy() - pdf.tc.iloc[0] * tile + reach
        all_cells = np.zeros((n, n))
        all_cells[r, c] = 1
        own = np.zeros((n, n))
        own[reach : reach + tile, reach : reach + tile] = all_cells[reach : reach + tile, reach : reach + tile]
        if not own.any():
            return pd.DataFrame({"radius": [], "pairs": []})
        # no own cell is nearer to the array's end than the reach, so nothing wraps round within it
        together = np.rint(np.fft.irfft2(np.conj(np.fft.rfft2(own)) * np.fft.rfft2(all_cells), s=(n, n))).astype(np.int64)
        return pd.DataFrame({"radius": radii, "pairs": [int(together[(d2 > 0) & (d2 <= k * k)].sum()) for k in radii]})

    sums = homes.groupBy("tr", "tc").applyInPandas(count, "radius int, pairs long")
    all_radii = mask.sparkSession.createDataFrame([(k,) for k in radii], "radius int")
    return all_radii.join(sums.groupBy("radius").agg(F.sum("pairs").alias("pairs")), "radius", "left").select("radius", (F.coalesce("pairs", F.lit(0)) / 2).cast("long").alias("pairs"))
