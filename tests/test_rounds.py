"""Selections, forests and graphs by rounds, against one pass over everything."""

import math

import numpy as np

from terrasift.operators import graph, links, selection

KERNEL = [(y, x, 1 - math.hypot(y, x) / 3) for y in range(-2, 3) for x in range(-2, 3) if math.hypot(y, x) < 3]


def points(seed, n, size=20):
    rng = np.random.default_rng(seed)
    cells = {(int(r), int(c)) for r, c in rng.integers(0, size, (n, 2))}
    return [(r, c, float(w)) for (r, c), w in zip(sorted(cells), rng.integers(1, 9, len(cells)), strict=True)]


def sequential_cover(cells, n, spacing=0.0, field=None):
    field = {(r, c): w for r, c, w in (field or cells)}
    cover, left, out = dict.fromkeys(field, 0.0), {(r, c) for r, c, _ in cells}, []
    while left and len(out) < n:
        gains = {p: sum(field[q] * max(k - cover[q], 0) for y, x, k in KERNEL if (q := (p[0] + y, p[1] + x)) in field) for p in left}
        best = min(left, key=lambda p: (-round(gains[p], 10), p))
        if gains[best] <= 1e-12:
            break
        out.append((*best, gains[best]))
        for y, x, k in KERNEL:
            q = (best[0] + y, best[1] + x)
            if q in cover:
                cover[q] = max(cover[q], k)
        left = {p for p in left if p != best and math.dist(p, best) >= spacing}
    return out


def test_coverage_equals_one_pass(spark):
    cells = points(1, 120)
    df = spark.createDataFrame(cells, "r int, c int, w double")
    for n, d2 in ((12, 1), (40, 8)):
        got = [(x.r, x.c, round(x.gain, 9)) for x in selection.cover_greedily(df, n, d2).collect()]
        assert got == [(r, c, round(g, 9)) for r, c, g in sequential_cover(cells, n, math.sqrt(d2))]
    assert selection.cover_greedily(df.limit(0), 3).count() == 0


def test_spaced_with_blocked_cells(spark):
    cells, blocked = points(2, 150), [(5, 5), (12, 3)]
    got = {(x.r, x.c) for x in selection.spaced(spark.createDataFrame(cells, "r int, c int, w double"), "w", 5, spark.createDataFrame(blocked, "r int, c int"), 15).collect()}
    kept = []
    for r, c, _ in sorted(cells, key=lambda x: (-x[2], x[0], x[1])):
        if all((r - a) ** 2 + (c - b) ** 2 >= 5 for a, b in [*kept, *blocked]):
            kept.append((r, c))
    assert got == set(kept[:15])


def test_random_order_along_strikes(spark):
    import hashlib

    rng = np.random.default_rng(3)
    cells = [(r, c, float(rng.integers(0, 180))) for r, c, _ in points(3, 200)]
    got = {(x.r, x.c) for x in selection.thin_along(spark.createDataFrame(cells, "r int, c int, strike double"), 4, 2, 9).collect()}
    kept = []
    for r, c, s in sorted(cells, key=lambda x: (hashlib.md5(f"9|{x[0]}|{x[1]}".encode()).hexdigest(), x[0], x[1])):
        def blocks(k, r=r, c=c):
            y, x, a = r - k[0], c - k[1], math.radians(k[2])
            return y * y + x * x <= 16 and ((y * math.cos(a) + x * math.sin(a)) / 4) ** 2 + ((x * math.cos(a) - y * math.sin(a)) / 2) ** 2 < 1 - 1e-9
        if not any(blocks(k) for k in kept):
            kept.append((r, c, s))
    assert got == {(r, c) for r, c, _ in kept}


def test_thinning_to_a_budget(spark):
    cells = points(4, 140)
    got = {(x.r, x.c) for x in selection.cover_thin(spark.createDataFrame(cells, "r int, c int, w double"), 20, 0.5).collect()}
    todo, kept = {(r, c) for r, c, _ in cells}, []
    field = {(r + y, c + x) for r, c in todo for y, x, _ in KERNEL}
    while len(kept) < 20:
        cover = {q: max([k for y, x, k in KERNEL if (q[0] - y, q[1] - x) in kept], default=0.0) for q in field}
        gain = {p: round(sum(max(k - cover[p[0] + y, p[1] + x], 0) for y, x, k in KERNEL), 9) for p in todo}
        peaks = [p for p in todo if gain[p] > 0 and all(gain[p] >= gain.get((p[0] + y, p[1] + x), 0) for y in (-1, 0, 1) for x in (-1, 0, 1))]
        batch = []
        for p in sorted(peaks, key=lambda p: (-gain[p], p)):
            if all(math.dist(p, q) >= 1.5 for q in batch):
                batch.append(p)
        batch = batch[: max(1, math.ceil((20 - len(kept)) * 0.5))]
        kept += batch
        todo -= set(batch)
    assert got == set(kept) and len(got) == 20


def test_least_forest_equals_kruskal(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(g)) for a, b, g in zip(rng.integers(0, 40, 120), rng.integers(0, 40, 120), rng.integers(1, 9, 120), strict=True)]
    got = sorted((min(x.a, x.b), max(x.a, x.b), x.gap) for x in graph.least_forest(spark.createDataFrame(rows, "a long, b long, gap double")).collect())
    root = {i: i for i in range(40)}
    want = []
    for g, a, b in sorted((g, min(a, b), max(a, b)) for a, b, g in rows):
        if root[a] != root[b]:
            want.append((a, b, g))
            old, new = root[b], root[a]
            root = {k: new if v == old else v for k, v in root.items()}
    assert got == sorted(want)


def test_graph_of_a_cross_and_a_segment(spark):
    rows = [(10, c) for c in range(3, 18)] + [(r, 10) for r in range(3, 18) if r != 10] + [(22, c) for c in range(4, 12)]
    mask = spark.createDataFrame(rows, "r int, c int")
    nodes, edges = graph.graph_nodes(mask, 30).collect(), graph.graph_edges(mask, 30).collect()
    assert sorted(n.kind for n in nodes) == ["end"] * 6 + ["junction"] and len(edges) == 5 and len({n.comp for n in nodes}) == 2
    junction = next(n for n in nodes if n.kind == "junction")
    assert (junction.r, junction.c) == (10, 10) and sum(junction.node in (e.u, e.v) for e in edges) == 4
    one = graph.graph_summary(mask, graph.graph_nodes(mask, 30), graph.graph_edges(mask, 30), 30, 30).first()
    assert (one.ends, one.junctions, one.systems, one.edges, one.loops, one.enclosed) == (6, 1, 2, 5, 0, 0)
    ring = [(r, c) for r in range(5, 15) for c in range(5, 15) if r in (5, 14) or c in (5, 14)] + [(5, 15), (5, 16)]
    ring = spark.createDataFrame([x for x in ring if x not in ((5, 5), (14, 5), (14, 14))], "r int, c int")
    one = graph.graph_summary(ring, graph.graph_nodes(ring, 30), graph.graph_edges(ring, 30), 30, 30).first()
    assert one.enclosed == 1 and one.enclosed_20 == 1 and one.loops >= 1
    ends = {(x.r, x.c): (x.ty, x.tx) for x in graph.end_tangents(mask, 30).collect()}
    assert np.allclose(ends[10, 3], (0, -1)) and np.allclose(ends[17, 10], (1, 0)) and np.allclose(ends[22, 11], (0, 1))


def test_marker_offset_of_two_ridges(spark):
    rows = [(10, c, 1) for c in range(2, 10)] + [(13, c, 2) for c in range(14, 22)]
    labelled = spark.createDataFrame(rows, "r int, c int, comp long")
    ends = links.outward(labelled, graph.endpoints(labelled).join(labelled, ["r", "c"]), 5).selectExpr("*", "0D as strike")
    valid = spark.createDataFrame([(r, c) for r in range(25) for c in range(25)], "r int, c int")
    got = links.marker_offsets(ends, valid, (2, 8), (1, 5), 20.0, math.cos(math.radians(50))).collect()
    assert [(x.r0, x.c0, x.r1, x.c1, x.gap, x.offset) for x in got] == [(10, 9, 13, 14, 5.0, 3.0)]
    assert links.marker_offsets(ends, valid.where("c <> 12"), (2, 8), (1, 5), 20.0, math.cos(math.radians(50))).count() == 0
    chosen = spark.createDataFrame([(10, 9, 13, 14)], "r int, c int, q_r int, q_c int")
    one = links.link_dots(chosen, spark.createDataFrame([(11, 12)], "r int, c int"), labelled).first()
    assert (one.dots, one.near_base, one.base_share, one.third) == (1, 1, 1.0, False)


def test_equal_gains_over_tiles_equal_one_pass(spark):
    """Full of equal gains: rounds over tiles follow the one pass, and the first n need few of them."""
    cells = [(r, c, 1.0) for r in range(187, 195) for c in range(184, 200)]
    df = spark.createDataFrame(cells, "r int, c int, w double")
    for n, d2 in ((3, 1), (9, 8)):
        got = [(x.r, x.c, round(x.gain, 9)) for x in selection.cover_greedily(df, n, d2).collect()]
        assert got == [(r, c, round(g, 9)) for r, c, g in sequential_cover(cells, n, math.sqrt(d2))]


def test_spaced_over_tiles_with_equal_scores(spark, monkeypatch):
    cells = [(r, c, 1.0) for r in range(186, 199) for c in range(186, 199)]
    kept = []
    for r, c, _ in cells:
        if all((r - a) ** 2 + (c - b) ** 2 >= 8 for a, b in kept):
            kept.append((r, c))
    df = spark.createDataFrame(cells, "r int, c int, w double")
    assert {(x.r, x.c) for x in selection.spaced(df, "w", 8).collect()} == set(kept)
    assert [(x.r, x.c) for x in selection.spaced(df, "w", 8, n=7).collect()] == kept[:7]
    assert selection.spaced(df.limit(0), "w", 8).columns == ["r", "c", "w"]
