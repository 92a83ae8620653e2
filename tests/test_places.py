"""Joins by place on tables with many rows at few places: plans must not pair all rows, and results stay those of all pairs."""

import math

from terrasift.operators import links, neighbours, segments
from terrasift.sources.files import thin_polylines


def test_rows_at_one_place_meet_once(spark):
    sites = spark.createDataFrame([(i, i % 3, i % 2, float(i), 10.0 * (i % 4)) for i in range(600)], "id long, r int, c int, w double, strike double")
    points = spark.createDataFrame([(i, i % 5, 2, 20.0) for i in range(400)], "id long, r int, c int, st double")
    rows, spots = sites.collect(), points.collect()
    seen = {}
    for p in spots:
        near = sorted(((p.r - s.r) ** 2 + (p.c - s.c) ** 2, s.id, s.w, s.strike) for s in rows if (p.r - s.r) ** 2 + (p.c - s.c) ** 2 <= 9)
        seen[p.id] = near
    from pyspark.sql import functions as F

    got = {r.a_id: (round(r.w, 6), r.n) for r in links.borrow(points.select("id", "r", "c"), sites.select("id", "r", "c", "w"), 3, F.lit(True), "w").collect()}
    mean = lambda x: sum(w / (math.sqrt(d) + 1) for d, _, w, _ in x) / sum(1 / (math.sqrt(d) + 1) for d, *_ in x)
    assert got == {k: (round(mean(v[:3]), 6), len(v[:3])) for k, v in seen.items() if v}
    agree = F.abs(F.col("a_st") - F.col("b_strike")) <= 5
    share = {r.a_id: (round(r.share, 6), r.n) for r in links.weighted_share(points, sites.select("id", "r", "c", "strike"), 3, agree, 20.0).collect()}
    weight = lambda d: math.exp(-math.sqrt(d) / 20)
    assert share == {k: (round(sum(weight(d) for d, _, _, s in v if abs(20 - s) <= 5) / sum(weight(d) for d, *_ in v), 6), len(v)) for k, v in seen.items() if v}
    near = {(r.r, r.c): (r.d2, r.near.id) for r in neighbours.nearest(points.select("r", "c").distinct(), sites.select("r", "c", "id"), 8).collect()}
    assert near == {(p.r, p.c): min(((p.r - s.r) ** 2 + (p.c - s.c) ** 2, s.r, s.c, s.id) for s in rows)[::3] for p in spots}


def test_equal_segments_count_once(spark):
    lines = spark.createDataFrame([(i, 1, 0, 0, 0, 9) for i in range(50)], "line long, seq int, r int, c int, q_r int, q_c int")
    got = segments.nearest_line(spark.createDataFrame([(r, 4) for r in range(6)], "r int, c int"), lines, 64.0, 0.5).collect()
    assert {(x.r, x.line, x.seq, x.d2) for x in got} == {(r, 0, 1, float(r * r)) for r in range(6)}


def test_thinned_lines_over_batches(spark):
    rows = [(n, k + 1, (k * 17 + n) % 50, (k * 29) % 50) for n in range(7) for k in range(1 + n * 9)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted(map(tuple, thin_polylines(spark.createDataFrame(rows, "line long, seq int, r int, c int"), 20.0).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for n in range(7):
        own, last = [x for x in rows if x[0] == n], None
        for i, x in enumerate(own):
            if last is None or i == len(own) - 1 or (x[2] - last[2]) ** 2 + (x[3] - last[3]) ** 2 >= 400:
                want.append(x)
                last = x
    assert got == sorted(want)
