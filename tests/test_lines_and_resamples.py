"""Distances to lines, bootstraps and digests against plain loops."""

import hashlib
import math

import numpy as np

from terrasift.operators import resampling, segments
from terrasift.sources.files import content_digest


def plain_distance(p, a, b):
    a, b, p = (np.array(x, float) for x in (a, b, p))
    d = b - a
    t = 0.0 if not d.any() else min(max(float((p - a) @ d / (d @ d)), 0.0), 1.0)
    return float(((p - a - t * d) ** 2).sum())


def test_nearest_lines_at_any_distance(spark):
    rng = np.random.default_rng(8)
    vertices = [(line, k, *map(int, rng.integers(0, 120, 2))) for line in range(12) for k in range(int(rng.integers(1, 5)))]
    vertices += [(90, 0, 5, 5), (90, 1, 5, 90), (91, 0, 300, 40), (91, 1, 420, 40), (92, 0, 60, 60), (92, 1, 60, 60)]  # level, upright, without length
    points = [(int(r), int(c)) for r, c in rng.integers(-20, 460, (150, 2))] + [(7, 8), (7, 8)]
    segs = segments.segments_of(spark.createDataFrame(vertices, "line long, seq int, r int, c int"))
    by = {}
    for line, k, r, c in vertices:
        by.setdefault(line, []).append((k, (r, c)))
    plain = [(line, v[i][0], v[i][1], v[min(i + 1, len(v) - 1)][1]) for line, v in by.items() for i in range(max(1, len(v) - 1))]
    assert {tuple(r) for r in segs.collect()} == {(line, k, *a, *b) for line, k, a, b in plain}
    got = {(r.r, r.c): (r.d2, r.line, r.seq) for r in segments.nearest_line(spark.createDataFrame(points, "r int, c int"), segs, 1000.0).collect()}
    assert set(got) == set(points)
    for p in set(points):
        want = min((round(plain_distance(p, a, b), 9), line, k) for line, k, a, b in plain)
        assert math.isclose(got[p][0], want[0], abs_tol=1e-8) and got[p][1:] == want[1:], p
    near = segments.nearest_line(spark.createDataFrame([(0, 0), (900, 900)], "r int, c int"), segs, 20.0).where("d2 is null").collect()
    assert [(r.r, r.c) for r in near] == [(900, 900)]
    assert segments.nearest_line(spark.createDataFrame(points, "r int, c int"), segs.limit(0), 20.0).where("line is null").count() == len(set(points))


def test_poisson_bootstraps(spark):
    rng = np.random.default_rng(2)
    w = resampling.weights(rng.integers(0, 2**62, 4000), 300, 5)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    x = rng.normal(3, 2, 2000)
    y = 1.5 * x + rng.normal(0, 1, 2000)
    df = spark.createDataFrame([(i, i // 20, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, block long, x double, y double")
    from pyspark.sql import functions as F

    cell = resampling.ratio_interval(df, ["id"], F.col("x"), F.lit(1.0), 800, 1).first()
    se = x.std() / math.sqrt(len(x))
    assert math.isclose(cell.lo, x.mean() - 1.96 * se, abs_tol=0.35 * se) and math.isclose(cell.hi, x.mean() + 1.96 * se, abs_tol=0.35 * se) and cell.used == 800 and cell.positive == 1
    again = resampling.ratio_interval(df.repartition(7), ["id"], F.col("x"), F.lit(1.0), 800, 1).first()
    assert math.isclose(cell.lo, again.lo, rel_tol=1e-9)
    blocks = resampling.resampled(df, ["block"], {"a": F.col("x"), "n": F.lit(1.0)}, 50, 3).toPandas()
    assert (np.round(blocks.n) % 20 == 0).all() and len(blocks) == 50
    both = resampling.paired_interval(df, ["id"], (F.col("y"), F.lit(1.0)), (F.col("x"), F.lit(1.0)), 800, 4).first()
    d = y - x
    assert math.isclose(both.hi - both.lo, 2 * 1.96 * d.std() / math.sqrt(len(d)), rel_tol=0.15) and both.lo < d.mean() < both.hi
    slope = resampling.slope_interval(df, ["id"], "x", "y", 800, 6).first()
    assert math.isclose(slope.slope, np.polyfit(x, y, 1)[0], rel_tol=1e-9) and math.isclose(slope.hi - slope.lo, 2 * 1.96 * 1 / (x.std() * math.sqrt(len(x))), rel_tol=0.2)
    none = resampling.ratio_interval(df.limit(0), ["id"], F.col("x"), F.lit(1.0), 10, 1).first()
    assert none.lo is None and none.used == 0


def plain_digest(keys):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {}
    for k in sorted(set(keys)):
        level.setdefault(k >> 8, []).append(str(k))
    level = {k: sha(",".join(v)) for k, v in level.items()}
    for shift in (8, 8, 8, 40):
        above = {}
        for k in sorted(level):
            above.setdefault(k >> shift, []).append(f"{k}:{level[k]}")
        level = {k: sha(",".join(v)) for k, v in above.items()}
    return level[0]


def test_digests_of_sets(spark):
    rng = np.random.default_rng(4)
    sets = {f: [int(k) for k in rng.integers(0, 2 ** (8 + 6 * f), 700)] for f in range(5)}
    df = spark.createDataFrame([(f, k) for f, v in sets.items() for k in v], "f int, k long")
    want = {f: plain_digest(v) for f, v in sets.items()}
    for n in (1, 5):
        got = {r.f: (r.digest, r["keys"]) for r in content_digest(df.repartition(n), "k", "f").collect()}
        assert got == {f: (want[f], len(set(v))) for f, v in sets.items()}
    assert content_digest(df.limit(0), "k", "f").count() == 0


def test_shortest_breaches(spark):
    rng = np.random.default_rng(11)
    vertices = [(line, k, *map(int, rng.integers(0, 60, 2) + 70 * np.array([line % 3, line % 2]))) for line in range(9) for k in range(3)]
    by = {}
    for line, k, r, c in vertices:
        by.setdefault(line, []).append((r, c))
    segs = segments.segments_of(spark.createDataFrame(vertices, "line long, seq int, r int, c int"))
    pairs = [(a, b) for a in range(9) for b in range(a + 1, 9)] + [(3, 99)]
    got = {(r.a, r.b): r.d2 for r in segments.shortest_breach(spark.createDataFrame(pairs, "a long, b long"), segs, 500.0).collect()}
    assert set(got) == set(pairs) and got[3, 99] is None

    def side(s, p):
        return (s[1][0] - s[0][0]) * (p[1] - s[0][1]) - (s[1][1] - s[0][1]) * (p[0] - s[0][0])

    for a, b in pairs[:-1]:
        best = math.inf
        for s in zip(by[a], by[a][1:], strict=False):
            for o in zip(by[b], by[b][1:], strict=False):
                if side(s, o[0]) * side(s, o[1]) < 0 and side(o, s[0]) * side(o, s[1]) < 0:
                    best = 0.0
                best = min([best, *(plain_distance(p, *o) for p in s), *(plain_distance(p, *s) for p in o)])
        assert math.isclose(got[a, b], best, abs_tol=1e-6), (a, b)
