"""Every query against its SQL in DuckDB on the smallest tables, and invariants of those without SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from terrasift.plans.all import ORACLES, QUERIES
from terrasift.sources.cells import cells, mask

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def comparable(df):
    def text(v):
        number = isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_))
        return repr(float(v)) if number else str(v)

    columns = sorted(df.columns)
    return df[columns].map(text).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours).equals(comparable(theirs))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def points(df):
    return {(r.r, r.c): r for r in df.collect()}


def test_spaced_set_is_independent_and_maximal(spark):
    x = cells(spark, DIR).where("flag = 'A'")
    all_, kept = points(x), points(QUERIES["q_spaced"](spark, DIR))
    near = lambda p: [q for dy in range(-2, 3) for dx in range(-2, 3) if 0 < dy * dy + dx * dx < 8 and (q := (p[0] + dy, p[1] + dx)) in kept]
    assert kept and all(not near(p) for p in kept)
    assert all(p in kept or any((kept[q].v, -q[0], -q[1]) > (all_[p].v, -p[0], -p[1]) for q in near(p)) for p in all_)


def test_thinning_keeps_spacing_and_covers(spark):
    from terrasift.operators.walks import thin

    m = mask(cells(spark, DIR), "q >= 30")
    all_, kept = points(m), points(thin(m, 256, 3))
    near = lambda p: [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (q := (p[0] + dy, p[1] + dx)) in kept]
    assert set(kept) <= set(all_) and all(not near(p) for p in kept) and all(p in kept or near(p) for p in all_)


def test_coverage_gains_fall(spark):
    gains = [r.gain for r in QUERIES["q_coverage_greedy"](spark, DIR).collect()]
    assert gains and all(g > 0 for g in gains)


def test_upward_continuation_keeps_a_constant(spark):
    from pyspark.sql import functions as F

    from terrasift.operators.surfaces import upward_continue

    flat = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("r"), (F.col("id") % 64).cast("int").alias("c"), F.lit(5.0).alias("v"))
    got = upward_continue(flat, "v", 64, 64, 0.5, 16).where("r between 20 and 40 and c between 20 and 40").agg(F.min("up"), F.max("up")).first()
    assert 4.5 < got[0] <= got[1] < 5.5


def test_metric_by_hand(spark):
    from terrasift.operators.metric import score

    truth = spark.createDataFrame([(0, 0), (0, 10)], "r int, c int")
    pred = spark.createDataFrame([(0, 0), (0, 9), (50, 50)], "r int, c int")
    got = score(pred, truth).first()
    assert abs(got.tp - (1 + 2 / 3)) < 1e-9 and abs(got.fp - (1 / 3 + 1)) < 1e-9 and (got.n, got.dots) == (2, 3)
    assert score(pred, truth.limit(0)).first().score == 0.0


def test_nonnegative_least_squares():
    from terrasift.operators.models import nonnegative_least_squares

    rng = np.random.default_rng(0)
    a, x = rng.random((30, 6)), np.array([0.0, 1.5, 0.0, 0.3, 2.0, 0.0])
    assert np.allclose(nonnegative_least_squares(a, a @ x), x, atol=1e-8)


def test_lonlat_of_a_known_point(spark):
    from pyspark.sql import functions as F

    from terrasift.functions.scalar import xy_to_lonlat

    lon, lat = xy_to_lonlat(F.lit(500000.0), F.lit(0.0))
    got = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(got.lon + 117) < 1e-9 and abs(got.lat) < 1e-9


def test_bridges(spark):
    from terrasift.operators.graph import bridges

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (8, 9), (8, 9)], "a long, b long")
    got = {(r.a, r.b) for r in bridges(links).where("bridge").collect()}
    assert got == {(3, 4)}


def test_euler_finds_a_point_source(spark):
    from terrasift.operators.surfaces import euler_windows

    rows = []
    for r in range(12):
        for c in range(12):
            y, x, z = r - 5.3, c - 6.4, -2.0
            d = (y * y + x * x + z * z) ** 0.5
            t, g = 1 / d, -1 / d**3
            rows.append((r, c, t + 7.0, y * g, x * g, z * g))
    got = euler_windows(spark.createDataFrame(rows, "r int, c int, t double, gy double, gx double, gz double"), 2, 1.0, 1.0).where("r = 5 and c = 5").first()
    assert abs(got.y0 - 5.3) < 1e-4 and abs(got.x0 - 6.4) < 1e-4 and abs(got.z0 - 2.0) < 1e-4 and abs(got.base - 7.0) < 1e-4


def test_thinning_along_a_strike(spark):
    from terrasift.operators.selection import thin_along

    line = spark.createDataFrame([(r, 5, 0.0) for r in range(9)] + [(0, 20 + c, 0.0) for c in range(9)], "r int, c int, strike double")
    got = {(x.r, x.c) for x in thin_along(line, 4, 2).collect()}
    assert {p for p in got if p[1] == 5} == {(0, 5), (4, 5), (8, 5)} and {p for p in got if p[1] >= 20} == {(0, 20 + c) for c in (0, 2, 4, 6, 8)}


def test_strict_json(spark):
    from terrasift.sources.files import strict_json

    rows = [('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ("",), (None,), ('{"a": {"b": [1, 2]}}',)]
    assert [r.valid for r in strict_json(spark.createDataFrame(rows, "t string"), "t").collect()] == [True, False, False, False, False, True]


def test_skeleton_matches_brute_force(spark):
    from terrasift.operators.surfaces import skeleton

    rng = np.random.default_rng(1)
    a = np.zeros((26, 26), int)
    a[3:12, 4:22] = 1
    a[10:22, 8:12] = 1
    a[rng.integers(3, 22, 25), rng.integers(3, 22, 25)] = 1
    rows = [(int(r), int(c)) for r, c in np.argwhere(a)]
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        size = a.sum()
        for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            gone = []
            for r, c in np.argwhere(a):
                p = [a[r + y, c + x] for y, x in around]
                rises = sum(p[i] == 0 and p[(i + 1) % 8] == 1 for i in range(8))
                if 2 <= sum(p) <= 6 and rises == 1 and not all(p[i] for i in first) and not all(p[i] for i in second):
                    gone.append((r, c))
            for g in gone:
                a[g] = 0
        if a.sum() == size:
            break
    got = {(x.r, x.c) for x in skeleton(spark.createDataFrame(rows, "r int, c int")).collect()}
    assert got == {(int(r), int(c)) for r, c in np.argwhere(a)}
