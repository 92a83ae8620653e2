"""Surfaces of sides, scales and windows, cell by cell against the same definitions on whole arrays."""

import math

import numpy as np
import pandas as pd
import pytest

from terrasift.operators import surfaces, textures
from terrasift.operators.statistics import robust_scale

N = 150
RNG = np.random.default_rng(7)
A, B, C = (RNG.normal(size=(N, N)).cumsum(0).cumsum(1) / 50 + RNG.normal(size=(N, N)) for _ in range(3))


def table(spark, keep=None, **bands):
    r, c = np.divmod(np.arange(N * N), N)
    pdf = pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32"), **{k: v.ravel() for k, v in bands.items()}})
    return spark.createDataFrame(pdf if keep is None else pdf[keep.ravel()])


def grid(df, *names):
    pdf = df.select("r", "c", *names).toPandas()
    out = np.full((len(names), N, N), np.nan)
    out[:, pdf.r, pdf.c] = pdf[list(names)].to_numpy(dtype=float).T
    return out[0] if len(names) == 1 else out


def lines(a, taps, axis, mode):
    k = len(taps) // 2
    a = np.pad(a, [(k, k) if i == axis else (0, 0) for i in (0, 1)], mode)
    return np.apply_along_axis(np.correlate, axis, a, taps, "valid")


def smooth(a, sigma, orders=(0, 0), mode="symmetric"):
    for axis in (0, 1):
        a = lines(a, surfaces.gaussian_taps(sigma, orders[axis]), axis, mode)
    return a


def nearest_filled(a, valid):
    """Filled from the nearest valid cell, ties in raster order."""
    out, known = a.copy(), np.argwhere(valid)
    for r, c in np.argwhere(~valid):
        d = (known[:, 0] - r) ** 2 + (known[:, 1] - c) ** 2
        out[r, c] = a[tuple(known[d.argmin()])]
    return out


def own_scale(a):
    mad = 1.4826 * np.median(np.abs(a - np.median(a)))
    return mad if mad > 0 else np.std(a) or 1.0


HOLES = np.ones((N, N), bool)
HOLES[40:52, 60:75] = False
HOLES[:9, :14] = False


def test_robust_scale_falls_back(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(3.0,)], "v double")
    assert math.isclose(robust_scale(df, "v", "s").first()["s"], np.std([1.0] * 5 + [3.0]))
    assert robust_scale(df.where("v = 1"), "v", "s").first()["s"] == 1.0


def test_texture_boundary(spark):
    bands = {"a": A.copy(), "b": B.copy(), "e": C.copy()}
    bands["a"][20:24, 30:33] = np.nan
    got = grid(textures.texture_boundary(table(spark, HOLES, **bands), ["a", "b", "e"], N, N), "a", "b", "e", "boundary")
    units = []
    for i, x in enumerate(bands.values()):
        valid = HOLES & np.isfinite(x)
        num, den = smooth(np.where(valid, x, 0), 3.0, mode="edge"), smooth(valid.astype(float), 3.0, mode="edge")
        filled = np.where(valid, x, num / np.maximum(den, 1e-6))
        z = np.where(HOLES, (filled - np.median(filled[HOLES])) / own_scale(filled[HOLES]), np.nan)
        wide = np.pad(z, 20, constant_values=np.nan)
        at = lambda y, x: wide[20 - y : 20 - y + N, 20 - x : 20 - x + N]  # noqa: B023, E731
        best = np.zeros((N, N))
        for ny, nx, ty, tx in ((0, 1, -1, 0), (1, 1, -1, 1), (1, 0, 0, 1), (1, -1, 1, 1)):
            change = np.zeros((N, N))
            for k in (2, 4, 8):
                sides = []
                for sign in (1, -1):
                    s = [at(sign * ny * k + j * ty * k, sign * nx * k + j * tx * k) for j in (0, -1, 1)]
                    m = sum(s) / 3
                    sides.append((s[1] - m) * (s[2] - m) / (sum((v - m) ** 2 for v in s) / 3 + 1e-6))
                change += np.abs(sides[0] - sides[1]) / 3
            best = np.maximum(best, np.nan_to_num(change, nan=0.0))
        want = np.clip(best, 0, 2)
        assert np.allclose(got[i][HOLES], want[HOLES], atol=1e-6)
        top = np.percentile(want[HOLES], 99)
        units.append(np.clip(want / (top if top > 0 else 1), 0, 1))
    assert np.allclose(got[3][HOLES], np.cbrt(units[0] * units[1] * units[2])[HOLES], atol=1e-6) and np.isnan(got[3][~HOLES]).all()


def test_potential_edges(spark):
    got = grid(textures.potential_edges(table(spark, HOLES, a=A, b=B), "a", "b", N, N), "a_0", "a_1", "b_0", "b_1", "concordance", "orientation")
    want, last = [], []
    for x in (A, B):
        filled = nearest_filled(x, HOLES)
        for sigma in (3.0, 10.0):
            gy, gx = np.gradient(smooth(filled, sigma, mode="edge"))
            size = np.hypot(gy, gx)
            lo, hi = np.percentile(size[HOLES], (5, 95))
            want.append(np.clip((size - lo) / (hi - lo), 0, 1))
        last.append((gy, gx, size))
    strong = HOLES & (last[0][2] >= np.percentile(last[0][2][HOLES], 10)) & (last[1][2] >= np.percentile(last[1][2][HOLES], 10))
    cosine = np.abs(last[0][0] * last[1][0] + last[0][1] * last[1][1]) / (last[0][2] * last[1][2])
    want += [np.where(strong, np.minimum(want[1], want[3]), 0), np.where(strong, cosine, 0)]
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g[HOLES], w[HOLES], atol=1e-6)


def test_vesselness(spark):
    got = grid(textures.vesselness(table(spark, HOLES, a=A), "a", N, N), "vesselness")
    filled, want = nearest_filled(A, HOLES), np.zeros((N, N))
    for s in (1.0, 2.0, 3.0):
        h = [s * s * smooth(filled, s, o, "edge") for o in ((0, 2), (1, 1), (2, 0))]
        e = np.linalg.eigvalsh(np.stack([np.stack([h[0], h[1]], -1), np.stack([h[1], h[2]], -1)], -2))
        order = np.argsort(np.abs(e), -1)
        small, large = (np.take_along_axis(e, order[..., k : k + 1], -1)[..., 0] for k in (0, 1))
        norm = np.hypot(small, large)
        c = norm[HOLES].max() / 2
        want = np.maximum(want, np.where(large < 0, np.exp(-((small / large) ** 2) / 0.5) * (1 - np.exp(-(norm**2) / (2 * c * c))), 0))
    assert np.allclose(got[HOLES], want[HOLES], atol=1e-6) and want.max() > 0.3
    assert textures.vesselness(table(spark, a=np.full((N, N), 7.0)), "a", N, N).where("vesselness > 0").count() == 0


def test_euler_windows(spark):
    y, x = np.indices((N, N)).astype(float)
    r = np.sqrt((y - 71.0) ** 2 + (x - 64.0) ** 2 + 6.0**2)
    t = 1000 / r
    up = {"t": t + 3.0, "gy": -1000 * (y - 71) / r**3, "gx": -1000 * (x - 64) / r**3, "gz": 1000 * 6.0 / r**3}
    up = {k: v + (0 if k == "t" else RNG.normal(0, 1e-4, (N, N))) for k, v in up.items()}
    out = textures.euler_windows(table(spark, HOLES, **up), 1.0, depth=(1.0, 30.0)).toPandas()
    starts = {(a, b) for a in range(0, N - 9, 4) for b in range(0, N - 9, 4) if HOLES[a : a + 10, b : b + 10].all()}
    assert set(zip(out.r, out.c, strict=True)) == starts
    best = out[out.passed == 4]
    assert len(best) >= 4 and np.allclose(best.row, 71, atol=0.5) and np.allclose(best.col, 64, atol=0.5) and np.allclose(best.depth.abs(), 6, atol=0.5)
    for _, w in out.sample(40, random_state=1).iterrows():
        a, b = int(w.r), int(w.c)
        part = {k: v[a : a + 10, b : b + 10].ravel() for k, v in up.items()}
        m = np.stack([part["gy"], part["gx"], part["gz"], np.ones(100)], 1)
        rhs = y[a : a + 10, b : b + 10].ravel() * part["gy"] + x[a : a + 10, b : b + 10].ravel() * part["gx"] + part["t"]
        norm = np.linalg.norm(m, axis=0)
        s = np.linalg.svd(m / norm, compute_uv=False)
        if s[-1] ** 2 <= 1e-9:
            continue
        fit = np.linalg.lstsq(m / norm, rhs, rcond=None)[0] / norm
        left = ((rhs - m @ fit) ** 2).sum()
        se = math.sqrt(left / 96 * np.linalg.inv((m / norm).T @ (m / norm))[2, 2]) / norm[2]
        assert np.allclose([w.row, w.col, w.depth], fit[:3], rtol=1e-3, atol=1e-2) and math.isclose(w.condition, s[0] / s[-1], rel_tol=1e-3)
        assert math.isclose(w.error, se / abs(fit[2]), rel_tol=0.05, abs_tol=1e-3)
        gates = [w.condition <= 1e5, 1 <= w.depth <= 30, w.error <= 0.15, a - 2 <= w.row <= a + 11 and b - 2 <= w.col <= b + 11]
        assert w.passed == (gates + [False]).index(False)


def test_lineaments(spark):
    ratio = np.round(120 + 40 * np.sin(np.add.outer(np.arange(N) / 5, np.arange(N) / 9)) + 20 * A / np.abs(A).max())
    ratio[60, 20:130] = 10
    ratio[100:110, 100:120] = 0
    valid = ratio > 0
    got = grid(surfaces.lineament_surface(table(spark, a=ratio), "a", N, N), "field", "score", "bonus")
    lo, hi = np.percentile(ratio[valid], (5, 95))
    fs = smooth(nearest_filled(np.clip((hi - ratio) / (hi - lo), 0, 1), valid), 1.0)
    seen = np.where(valid, fs, 0)
    gy, gx = np.gradient(seen)
    sector = np.floor(((np.mod(np.arctan2(gy, gx), np.pi) + np.pi / 8) % np.pi) / (np.pi / 4)).astype(int)
    p = np.pad(seen, 1, constant_values=-np.inf)
    at = lambda y, x: p[1 + y : 1 + y + N, 1 + x : 1 + x + N]
    ridge = np.zeros((N, N), bool)
    for k, (a, b) in enumerate((((0, -1), (0, 1)), ((-1, 1), (1, -1)), ((-1, 0), (1, 0)), ((-1, -1), (1, 1)))):
        ridge |= (sector == k) & (seen >= at(*a)) & (seen > at(*b))
    wide = np.pad(fs, 10)
    means = np.stack([sum(wide[10 + i * y : 10 + i * y + N, 10 + i * x : 10 + i * x + N] for i in range(-10, 11)) / 21 for y, x in ((1, 0), (1, 1), (0, 1), (1, -1))])
    top, mean = means.max(0), means.mean(0)
    score = np.where(ridge & valid & (seen > 0), np.clip(top, 0, 1) * (0.5 + 0.5 * np.where(top > 0, (top - mean) / np.maximum(top, 1e-12), 0)), 0)
    box = np.pad(score, 3)
    bonus = np.where(valid, np.max([box[y : y + N, x : x + N] for y in range(7) for x in range(7)], 0), 0)
    assert np.allclose(got[0], seen, atol=1e-9)
    # where two values are equal up to rounding, the direction of the slope may fall either way
    assert (np.abs(got[1] - score) > 1e-6).mean() < 0.002 and (np.abs(got[2] - bonus) > 1e-6).mean() < 0.05
    assert got[1][60, 30:120].max() > 0.5
    with pytest.raises(ValueError, match="range"):
        surfaces.lineament_surface(table(spark, a=np.full((N, N), 5.0)), "a", N, N)


def test_phase_energy(spark):
    x = A + np.where(np.arange(N)[None, :] < 75, 0.0, 6.0)
    x[10:13, 10:13] = np.nan
    got = grid(surfaces.phase_energy(table(spark, HOLES, a=x), "a", N, N), "energy")
    valid = HOLES & np.isfinite(x)
    v, w = np.where(valid, x, 0.0), valid.astype(float)
    filled = np.where(valid, v, smooth(v, 7.0) / np.maximum(smooth(w, 7.0), 1e-9))
    hp = filled - smooth(filled, 20.0)
    z = hp / own_scale(hp[HOLES])
    fields = [[s ** sum(o) * smooth(z, s, o) for o in ((1, 0), (0, 1), (2, 0), (0, 2), (1, 1))] for s in (1.0, 2.0, 4.0, 7.0)]
    phase, strength = np.zeros((N, N)), np.zeros((N, N))
    for k in range(8):
        c, n = math.cos(math.pi * k / 8), math.sin(math.pi * k / 8)
        odd = [c * gx + n * gy for gy, gx, _, _, _ in fields]
        even = [c * c * gxx + 2 * c * n * gxy + n * n * gyy for _, _, gyy, gxx, gxy in fields]
        size = sum(np.hypot(o, e) for o, e in zip(odd, even, strict=True))
        share = sum(map(np.abs, odd)) / (sum(map(np.abs, odd)) + sum(map(np.abs, even)) + 1e-6)
        phase, strength = np.maximum(phase, np.abs(sum(odd)) / (size + 1e-6) * share), np.maximum(strength, size)
    want = phase * np.log1p(strength / own_scale(strength[HOLES]))
    assert np.allclose(got[HOLES], want[HOLES], atol=1e-6) and np.isnan(got[~HOLES]).all()


def test_pair_counts(spark):
    cells = {(int(r), int(c)) for r, c in RNG.integers(0, 300, (500, 2))} | {(r, c) for r in range(120, 140) for c in range(120, 136)}
    p = np.array(sorted(cells))
    d2 = ((p[:, None, :] - p[None, :, :]) ** 2).sum(-1)
    got = {r.radius: r.pairs for r in textures.pair_counts(spark.createDataFrame([(int(a), int(b)) for a, b in p], "r int, c int"), [3, 9, 20]).collect()}
    assert got == {k: int(((d2 > 0) & (d2 <= k * k)).sum()) // 2 for k in (3, 9, 20)}
    assert [tuple(r) for r in textures.pair_counts(spark.createDataFrame([], "r int, c int"), [3]).collect()] == [(3, 0)]
