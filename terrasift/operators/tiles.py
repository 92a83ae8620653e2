"""Filters over tiles with halos, and filters in the frequency domain, for fields on a full grid.

A tile is a group of bounded size: its own cells and a halo as wide as the filter reaches. A frequency filter
works on whole lines: rows are transformed where a row lies, columns after one shuffle, and back after another,
so no task holds the field.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 128
#: Frequencies of a row that travel together to their columns.
LINES = 32


class Tile:
    """Arrays of a tile's bands with their halo; ``inside`` marks cells of the table."""

    def __init__(self, bands: dict[str, np.ndarray], inside: np.ndarray, r0: int, c0: int):
        self.bands, self.inside, self.r0, self.c0 = bands, inside, r0, c0

    def __getitem__(self, name: str) -> np.ndarray:
        return self.bands[name]


def tiled(cells: DataFrame, values: list[str], halo: int, solve: Callable[[Tile], dict[str, np.ndarray]], names: list[str], tile: int | None = None, nearest_of: tuple[int, int] | None = None, reflect_of: tuple[int, int] | None = None) -> DataFrame:
    """(r, c, names...) of ``solve`` on each tile; missing cells and nulls are 0 there.

    With ``nearest_of`` (height, width), cells beyond the grid take the value of the nearest cell of its edge; with
    ``reflect_of``, that of the cell as far within the edge (the edge's own cell for the first beyond it). A tile is
    at least twice as wide as the halo, so that halos are no more than four times what they surround.
    """
    tile = max(TILE, 2 * halo) if tile is None else tile
    edges = nearest_of or reflect_of
    far = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int")))
    homes = cells.select("r", "c", *[F.col(v).cast("double").alias(v) for v in values], far("r").alias("tr")).select("*", far("c").alias("tc"))
    n = tile + 2 * halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        r0, c0 = tr * tile - halo, tc * tile - halo
        r, c = pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0
        inside = np.zeros((n, n), bool)
        inside[r, c] = True
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        bands = {}
        for v in values:
            a = np.zeros((n, n))
            a[r, c] = np.nan_to_num(pdf[v].to_numpy(dtype=float), nan=0.0)
            if edges:
                a = a[_kept_within(n, r0, edges[0], bool(reflect_of))][:, _kept_within(n, c0, edges[1], bool(reflect_of))]
            bands[v] = a
        if not own.any():
            return pd.DataFrame({"r": [], "c": [], **{k: [] for k in names}})
        out = solve(Tile(bands, inside, r0, c0))
        return pd.DataFrame({"r": pdf.r[own], "c": pdf.c[own], **{k: out[k][r[own], c[own]] for k in names}})

    return homes.groupBy("tr", "tc").applyInPandas(run, ", ".join(["r int", "c int", *(f"`{k}` double" for k in names)]))


def _kept_within(n: int, first: int, size: int, reflect: bool) -> np.ndarray:
    """Where in a tile that begins at ``first`` each of its lines takes its values from, for a grid of ``size`` lines."""
    at = np.arange(n) + first
    if reflect:
        at = at % (2 * size)
        at = np.where(at < size, at, 2 * size - 1 - at)
    return np.clip(at - first, max(0, -first), min(n, size - first) - 1)


def correlate(a: np.ndarray, rows: list[float], cols: list[float]) -> np.ndarray:
    """Correlation with an outer product of two kernels, 0 beyond the array."""
    for axis, taps in ((0, rows), (1, cols)):
        k, n = len(taps) // 2, a.shape[axis]
        out = np.zeros_like(a)
        for i, w in enumerate(taps):
            lo, hi = max(0, k - i), min(n, n + k - i)
            if lo < hi and w:
                to, of = [slice(None)] * 2, [slice(None)] * 2
                to[axis], of[axis] = slice(lo, hi), slice(lo + i - k, hi + i - k)
                out[tuple(to)] += w * a[tuple(of)]
        a = out
    return a


def slope(a: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences by row and column, one-sided next to cells that are not inside, 0 for lone cells."""
    out = []
    for axis in (0, 1):
        ahead, behind = np.roll(a, -1, axis), np.roll(a, 1, axis)
        on, before = np.roll(inside, -1, axis), np.roll(inside, 1, axis)
        out.append(np.where(on & before, (ahead - behind) / 2, np.where(on, ahead - a, np.where(before, a - behind, 0.0))))
    return out[0], out[1]


def _reflected(n: int, pad: int) -> np.ndarray:
    """Indices of a line reflected about its end cells, any number of times."""
    at = np.arange(-pad, n + pad) % max(2 * (n - 1), 1)
    return np.where(at < n, at, 2 * (n - 1) - at) if n > 1 else np.zeros(n + 2 * pad, int)


def spectral(cells: DataFrame, value: str, height: int, width: int, pad: int, factors: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(r, c, names...): a full field filtered by functions of the angular wavenumber per cell, reflected by ``pad`` cells.

    The mean is taken off first and given back in proportion to a factor's value at 0. Rows and columns are
    transformed apart: two shuffles of the field's transform, in blocks of ``LINES`` frequencies, whatever its size.
    Cells that are missing count as the mean.
    """
    mean = float(cells.agg(F.avg(value)).first()[0] or 0.0)
    long_r, long_c = height + 2 * pad, width + 2 * pad
    kx = 2 * np.pi * np.fft.rfftfreq(long_c)
    ky = 2 * np.pi * np.fft.fftfreq(long_r)
    names = list(factors)
    rows_at, cols_at = _reflected(height, pad), _reflected(width, pad)

    def by_row(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(width)
        line[pdf.c.to_numpy()] = np.nan_to_num(pdf[value].to_numpy(dtype=float) - mean, nan=0.0)
        f = np.fft.rfft(line[cols_at])
        cuts = range(0, len(f), LINES)
        return pd.DataFrame({"r": int(pdf.r.iloc[0]), "b": [k // LINES for k in cuts], "re": [f.real[k : k + LINES] for k in cuts], "im": [f.imag[k : k + LINES] for k in cuts]})

    def by_column(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf.b.iloc[0])
        own = kx[b * LINES : (b + 1) * LINES]
        f = np.zeros((height, len(own)), complex)
        f[pdf.r.to_numpy()] = np.stack(pdf.re.to_numpy()) + 1j * np.stack(pdf.im.to_numpy())
        f = np.fft.fft(f[rows_at], axis=0)
        k = np.hypot(ky[:, None], own[None, :])
        out = {"r": np.arange(height), "b": b}
        for i, name in enumerate(names):
            x = np.fft.ifft(f * factors[name](k), axis=0)[pad : pad + height]
            out[f"re{i}"], out[f"im{i}"] = list(x.real), list(x.imag)
        return pd.DataFrame(out)

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        out = {"r": int(pdf.r.iloc[0]), "c": np.arange(width)}
        for i, name in enumerate(names):
            f = np.concatenate(pdf[f"re{i}"].to_numpy()) + 1j * np.concatenate(pdf[f"im{i}"].to_numpy())
            out[name] = np.fft.irfft(f, long_c)[pad : pad + width] + mean * float(factors[name](np.zeros(1))[0])
        return pd.DataFrame(out)

    parts = cells.select("r", "c", value).groupBy("r").applyInPandas(by_row, "r int, b int, re array<double>, im array<double>")
    middle = ", ".join(["r int", "b int", *(f"re{i} array<double>, im{i} array<double>" for i in range(len(names)))])
    filtered = parts.groupBy("b").applyInPandas(by_column, middle)
    return filtered.groupBy("r").applyInPandas(back, ", ".join(["r int", "c int", *(f"`{k}` double" for k in names)])).join(cells.select("r", "c"), ["r", "c"], "left_semi")


def grid_cells(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(r, c) of every cell of a grid."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))


def full_grid(cells: DataFrame, values: list[str], height: int, width: int, tests: dict[str, Column] | None = None) -> DataFrame:
    """Every cell of the grid with the bands; where a band is missing (or its test fails), the nearest cell's that has it."""
    from .neighbours import nearest

    out = grid = grid_cells(cells.sparkSession, height, width)
    for v in values:
        good = F.col(v).isNotNull() if not tests or v not in tests else F.coalesce(tests[v], F.lit(False))
        known = cells.where(good).select("r", "c", F.col(v).cast("double").alias(v))
        lacking = nearest(grid.join(known, ["r", "c"], "left_anti"), known, max(height, width)).select("r", "c", F.col("near")[v].alias(v))
        out = out.join(known.unionByName(lacking), ["r", "c"], "left")
    return out
