"""Breadth-first order and thinning by rounds against one queue over the whole mask."""

import collections
import math

import numpy as np
import pytest

from terrasift.operators import walks

AROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]


def one_queue(cells):
    """Cells in the order of one queue, components by their first cell."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        queue = collections.deque([start])
        while queue:
            r, c = queue.popleft()
            out.append((r, c))
            for y, x in AROUND:
                if (r + y, c + x) in left:
                    left.discard((r + y, c + x))
                    queue.append((r + y, c + x))
    return out


def kept_of(order, blocked_by):
    blocked, kept = set(), []
    for r, c in order:
        if (r, c) not in blocked:
            kept.append((r, c))
            blocked.update((r + y, c + x) for y, x in blocked_by(r, c))
    return set(kept)


def masks():
    rng = np.random.default_rng(4)
    yield {(int(r), int(c)) for r, c in rng.integers(0, 45, (900, 2))}
    line = {(5 + round(6 * math.sin(c / 17)), c) for c in range(400)} | {(r, 120) for r in range(3, 110)}
    yield line | {(int(r) + 60, int(c) + 150) for r, c in rng.integers(0, 40, (500, 2))}


@pytest.mark.parametrize("k", [0, 1])
def test_order_and_thinning_are_those_of_one_queue(spark, k):
    cells = list(masks())[k]
    df = spark.createDataFrame(sorted(cells), "r int, c int")
    walked = walks.breadth_first(df, 500)
    got = [(x.r, x.c) for x in walked.orderBy(*walks.WALK).collect()]
    assert got == one_queue(cells)
    for d2 in (3, 9)[: 2 - k]:
        near = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if y * y + x * x < d2]
        kept = {(x.r, x.c) for x in walks.thin(df, 500, d2, walked).collect()}
        assert kept == kept_of(got, lambda r, c: near)  # noqa: B023
    assert walks.thin(df.limit(0), 500, 3).count() == 0


def test_thinning_along_strikes(spark):
    cells = next(masks())
    strike = {p: None if sum(p) % 9 == 0 else float((p[0] * 7 + p[1] * 13) % 180) for p in cells}
    df = spark.createDataFrame([(*p, s) for p, s in sorted(strike.items())], "r int, c int, strike double")
    got = {(x.r, x.c) for x in walks.thin_along(df, 500, 4.0, 1.5).collect()}

    def blocked_by(r, c):
        a = strike[r, c]
        for y in range(-4, 5):
            for x in range(-4, 5):
                if a is None:
                    if y * y + x * x < 16:
                        yield y, x
                else:
                    u, v = math.cos(math.radians(a)), math.sin(math.radians(a))
                    if ((y * u + x * v) / 4) ** 2 + ((x * u - y * v) / 1.5) ** 2 < 1 - 1e-9:
                        yield y, x

    assert got == kept_of(one_queue(cells), blocked_by)


def test_ladder_and_its_fit(spark):
    assert walks.rungs(3) == [1, 2, 4, 5, 8, 9]
    rng = np.random.default_rng(6)
    emission = {(int(r), int(c)) for r, c in rng.integers(0, 30, (300, 2))}
    stand = {(10, c) for c in range(40)} | {(r, 20) for r in range(30)}
    e, s = (spark.createDataFrame(sorted(x), "r int, c int") for x in (emission, stand))
    got = walks.ladder(e, s, 64, [4, 9]).orderBy("min_d2").collect()
    for r in got:
        near = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if y * y + x * x < r.min_d2]
        dots, kept = kept_of(one_queue(emission), lambda a, b: near), kept_of(one_queue(stand), lambda a, b: near)  # noqa: B023
        credit = sum(max(max(0, 1 - math.dist(p, q) / 3) for q in kept) for p in stand)
        assert (r.dots, r.stand_dots) == (len(dots), len(kept)) and math.isclose(r.retention, credit / len(stand))
    steps = spark.createDataFrame([(1, 1000, 60, 1.0), (4, 500, 30, 0.8), (9, 300, 20, 0.6), (16, 200, 15, 0.4)], "min_d2 int, dots long, stand_dots long, retention double")
    known = {d: float(walks.predicted_score(400 * k, 900, n, 0.12)) for d, n, k in ((1, 1000, 1.0), (4, 500, 0.8), (9, 300, 0.6))}
    credit, truth, left_out = walks.fit_operating_point(steps, known, 0.12)
    assert math.isclose(credit, 400, rel_tol=1e-6) and math.isclose(truth, 900, rel_tol=1e-6)
    assert len(left_out) == 3 and all(abs(x["predicted"] - x["score"]) < 1e-7 for x in left_out)
    out = {r.min_d2: r for r in walks.with_predictions(steps, credit, truth, 0.12).collect()}
    assert math.isclose(out[16].score, walks.predicted_score(160, 900, 200, 0.12), rel_tol=1e-6) and out[16].go_on is None
    for a, b, lost, gone in ((1, 4, 80, 500), (4, 9, 80, 200), (9, 16, 80, 100)):
        assert out[a].go_on == (lost / gone < 0.2 * out[a].score / (1 - 0.2 * out[a].score)), b
    with pytest.raises(ValueError, match="equal"):
        walks.fit_operating_point(steps.where("min_d2 = 1"), {1: 0.2}, 0.1)
