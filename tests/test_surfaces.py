"""Tile and frequency filters against the same formulas on the whole array."""

import numpy as np

from terrasift.operators import models, surfaces
from terrasift.operators.tiles import correlate, full_grid, slope, spectral

N = 150
RNG = np.random.default_rng(7)
A, B, C = (RNG.normal(size=(N, N)).cumsum(0).cumsum(1) / 50 for _ in range(3))


def table(spark, **bands):
    r, c = np.divmod(np.arange(N * N), N)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"r": r.astype("int32"), "c": c.astype("int32"), **{k: v.ravel() for k, v in bands.items()}}))


def grid(df, name):
    pdf = df.select("r", "c", name).toPandas()
    out = np.full((N, N), np.nan)
    out[pdf.r, pdf.c] = pdf[name]
    return out


def smooth(a, sigma, order=0):
    taps = surfaces.gaussian_taps(sigma)
    k = len(taps) // 2
    return correlate(np.pad(a, k, "edge"), taps, taps)[k:-k, k:-k]


def test_tiles_equal_the_whole_array(spark):
    g = surfaces.gaussian_taps(3.0)
    df = table(spark, a=A, b=B, s=C)
    got = grid(surfaces.separable(df, g, g, "a", "out", (N, N)), "out")
    assert np.allclose(got, smooth(A, 3.0), atol=1e-9)
    whole = np.ones((N, N), bool)
    inner = slice(1, -1)
    gy, gx = slope(A, whole)
    want = np.gradient(A)
    assert np.allclose(gy[inner, inner], want[0][inner, inner]) and np.allclose(gx[inner, inner], want[1][inner, inner])
    feature = surfaces.step_features(df, "a", "b", "s", N, N)
    coarse = np.hypot(*np.gradient(smooth(A, 10.0)))
    lo, hi = np.percentile(coarse, (5, 95))
    assert np.allclose(grid(feature, "depth_coarse"), np.clip((coarse - lo) / (hi - lo), 0, 1), atol=1e-6)
    other = np.hypot(*np.gradient(smooth(B, 10.0)))
    weak = (coarse < np.percentile(coarse, 10)) | (other < np.percentile(other, 10))
    assert (grid(feature, "concordance")[weak] == 0).all() and (grid(feature, "orientation")[~weak] > 0).all()


def test_spectral_equals_the_whole_transform(spark):
    pad = 40
    got = spectral(table(spark, a=A), "a", N, N, pad, {"up": lambda k: np.exp(-3 * k), "vz": lambda k: k * np.exp(-3 * k)})
    f = np.pad(A - A.mean(), pad, "reflect")
    k = np.hypot(2 * np.pi * np.fft.fftfreq(len(f))[:, None], 2 * np.pi * np.fft.rfftfreq(len(f))[None, :])
    for name, factor, mean in (("up", np.exp(-3 * k), A.mean()), ("vz", k * np.exp(-3 * k), 0.0)):
        want = np.fft.irfft2(np.fft.rfft2(f) * factor, s=f.shape)[pad:-pad, pad:-pad] + mean
        assert np.allclose(grid(got, name), want, atol=1e-9)


def test_depth_slices_and_derivatives(spark):
    df = table(spark, a=A, b=B)
    got = surfaces.depth_slices(df, "a", "b", N, N, (5.0, 10.0), 40)
    persist = grid(got, "persist")
    assert (persist >= 0).all() and (persist <= 1).all()
    order = persist.ravel().argsort(kind="stable")
    assert np.allclose(grid(got, "rank").ravel()[order], np.arange(N * N) / (N * N - 1))
    down = surfaces.magnetic_derivatives(df, "a", N, N, 64, 32)
    gz = grid(down, "gz")
    assert np.isfinite(gz[16:112, 16:112]).all() and np.isnan(gz[:16]).all()
    x = np.linspace(0, 1, 64)
    edge = np.minimum(x, 1 - x)
    w = np.where(edge < 0.125, 0.5 * (1 + np.cos(np.pi * (edge / 0.125 - 1))), 1.0)
    k = np.hypot(2 * np.pi * np.fft.fftfreq(64)[:, None], 2 * np.pi * np.fft.rfftfreq(64)[None, :])
    want = np.fft.irfft2(np.fft.rfft2(A[32:96, 0:64] * np.outer(w, w)) * k, s=(64, 64))
    assert np.allclose(gz[48:80, 16:48], want[16:48, 16:48], atol=1e-9)
    assert np.allclose(grid(down, "gx")[5, 1:-1], (A[5, 2:] - A[5, :-2]) / 2)


def test_context(spark):
    stripes = np.sin(np.arange(N) / 2.0)[None, :] * np.ones((N, 1))
    got = grid(surfaces.context_bands(table(spark, a=stripes), "a", N, N), "coherence")
    assert (got[20:-20, 20:-20] > 0.95).all()


def test_migration_of_a_shifted_ridge(spark):
    level = lambda c: spark.createDataFrame([(r, c) for r in range(20, 120)], "r int, c int")
    cells = table(spark, gy=np.zeros((N, N)), gx=np.ones((N, N)))
    got = surfaces.migration_bands([level(60), level(63)], cells, "gy", "gx", N)
    assert np.allclose(grid(got, "vx")[40:100, 60], 3) and np.allclose(grid(got, "signed")[40:100, 60], 3) and np.allclose(grid(got, "vy")[40:100, 60], 0)
    assert np.allclose(grid(got, "coherence")[50, 60], (1 + np.exp(-1.5)) / 2) and (grid(got, "vx")[:, 90:] == 0).all()


def test_full_grid_fills_from_the_nearest(spark):
    some = spark.createDataFrame([(0, 0, 1.0, None), (3, 3, 2.0, 5.0)], "r int, c int, a double, b double")
    got = {(x.r, x.c): (x.a, x.b) for x in full_grid(some, ["a", "b"], 4, 4).collect()}
    assert len(got) == 16 and got[0, 1] == (1.0, 5.0) and got[3, 2] == (2.0, 5.0) and got[1, 2] == (1.0, 5.0) or got[1, 2] == (2.0, 5.0)


def test_boosting_keeps_its_buffer_and_its_prior(spark):
    rng = np.random.default_rng(9)
    rows = [(r, c, float(y + rng.normal(0, 0.3)), y, r // 20, r < 30) for r in range(40) for c in range(40) for y in [int((r * 7 + c * 3) % 5 == 0)]]
    df = spark.createDataFrame(rows, "r int, c int, x double, label int, fold int, train boolean")
    seen = []
    real = models.GBTClassifier.fit
    models.GBTClassifier.fit = lambda self, data, *a: (seen.append(data.select("r", "fold").distinct().collect()), real(self, data, *a))[1]
    try:
        out = models.out_of_fold(df, ["x"], "label", "fold", 2, buffer=6).toPandas()
    finally:
        models.GBTClassifier.fit = real
    assert min(x.r for x in seen[0]) == 26 and max(x.r for x in seen[1]) == 13 and len(out) == 1600
    assert out[out.label == 1].prob.mean() > out[out.label == 0].prob.mean() + 0.4
    got = models.prior_calibrated(df, ["x"], "label", "train", 300).toPandas()
    assert abs(got.prob.mean() - got.label.mean()) < 0.06
    assert models.quadrant_surface(df, ["x"], "label", "fold", 2, 100, 500).count() == 1600
