"""Rooted forests, bridges and link values against plain walks over small and large graphs."""

import math

import numpy as np
import pytest

from terrasift.operators import trees


def plain_bridges(n, links):
    """Positions of links that are bridges, by depth-first low points."""
    around = [[] for _ in range(n)]
    for i, (a, b) in enumerate(links):
        around[a].append((b, i))
        around[b].append((a, i))
    order, low, found = [-1] * n, [0] * n, set()
    count = 0
    for start in range(n):
        if order[start] >= 0:
            continue
        order[start] = low[start] = count
        count += 1
        stack = [(start, -1, iter(around[start]))]
        while stack:
            v, by, rest = stack[-1]
            for w, i in rest:
                if i == by:
                    continue
                if order[w] >= 0:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = count
                    count += 1
                    stack.append((w, i, iter(around[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > order[u]:
                        found.add(by)
    return found


def merged_lengths(length, links, drop=None):
    parent, total = list(range(len(length))), [float(x) for x in length]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(range(len(links)), key=lambda i: (links[i][2], *links[i][:2])):
        a, b = find(links[i][0]), find(links[i][1])
        if i != drop and a != b:
            total[a] += total[b] + links[i][2]
            parent[b], total[b] = a, 0.0
    return [x for x in total if x > 0]


@pytest.mark.parametrize("seed", range(1))
def test_link_values_are_those_of_removing_each_link(spark, seed):
    rng = np.random.default_rng(seed)
    n = 25
    length = rng.integers(0, 6, n).astype(float).tolist()
    links = [(int(a), int(b), float(g) + 0.001 * i) for i, (a, b, g) in enumerate(zip(rng.integers(0, n, 30), rng.integers(0, n, 30), rng.integers(1, 9, 30), strict=True))]
    shortest, one = 8.0, trees.connectivity_of_one(2.5, 1.57, 2.0, 200.0)
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(length)], "node long, length double")
    got = trees.link_values(nodes, spark.createDataFrame(links, "a long, b long, gap double"), shortest, one).collect()
    assert len(got) == 30
    by = {(r.a, r.b, r.gap): r for r in got}
    sure, full = plain_bridges(n, [x[:2] for x in links]), merged_lengths(length, links)
    state = lambda x: (one * sum(v >= shortest for v in x), max(x) / sum(x), sum(v * v for v in x))
    want = {}
    for i, k in enumerate(links):
        without = state(merged_lengths(length, links, i))
        r, change = by[k], [p - q for p, q in zip(state(full), without, strict=True)]
        assert r.bridge == (i in sure) and math.isclose(r.merged, length[k[0]] + length[k[1]] + k[2])
        assert np.allclose([r.connectivity, r.share, r.moment], change, atol=1e-9)
        want[k] = (-round(abs(change[0]), 9), -round(abs(change[2]), 6), -round(r.merged, 9), k[2], k[0], k[1])
    assert [k for k in sorted(by, key=lambda k: by[k]["rank"])] == sorted(links, key=want.get)


def test_bridges_of_many_links(spark):
    rng = np.random.default_rng(5)
    n, m = 90_000, 100_000
    links = list(zip(rng.integers(0, n, m).tolist(), rng.integers(0, n, m).tolist(), strict=True))
    links += [(0, i) for i in range(1, 3000)] + [(n + i, n + i + 1) for i in range(3000)] + [(7, 7), (n, n + 1)]  # a hub, a chain, a loop and a parallel link
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(links)], "a long, b long, id long")
    got = {r.id for r in trees.bridges(df).where("bridge").collect()}
    assert got == plain_bridges(n + 3001, links)


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, gap double")
    nodes = spark.createDataFrame([(1, 2.0)], "node long, length double")
    assert trees.link_values(nodes, none, 1.0, 1.0).count() == 0 and trees.bridges(none).count() == 0
    loop = trees.link_values(nodes, spark.createDataFrame([(1, 1, 1.0)], "a long, b long, gap double"), 1.0, 1.0).first()
    assert (loop.bridge, loop.connectivity, loop["rank"]) == (False, 0.0, 1)


def test_connectivity_closed_form():
    beta = 1.5 * 2000**1.5 / 227_318**1.566
    e = 1.566 + 1 - 2.5
    want = beta * (1.566 * 227_318**e / (e * 1.5) - 2000**e / e)
    assert math.isclose(trees.connectivity_of_one(2.5, 1.566, 2000, 227_318), want)
    near, at = trees.connectivity_of_one(2.5, 1.5 + 1e-7, 2.0, 100.0), trees.connectivity_of_one(2.5, 1.5, 2.0, 100.0)
    assert math.isclose(near, at, rel_tol=1e-4)
