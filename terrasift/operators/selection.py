"""Choosing dots: top-k, spaced maximal sets, thinning, greedy coverage."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import RADIUS, kernel
from ..storage import forget, stored
from .metric import gain_map
from .neighbours import KERNEL, WITHIN3, near_distance, offsets, spread
from .statistics import quantile_cut
from .walks import TILE, choose_in_order, in_tiles


def top_k(df: DataFrame, score: str, k: int, *by: str) -> DataFrame:
    """The k highest scores, ties in raster order; per value of ``by`` if given."""
    if not by:
        return df.orderBy(F.desc(score), "r", "c").limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "r", "c"))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def spaced(cells: DataFrame, score: str, min_d2: int, blocked: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """The set that taking cells by falling score (ties in raster order), never nearer than the spacing, gives.

    The order defines it uniquely; tiles decide their cells at once as far as others cannot change them, so long
    chains of equal scores cost rounds only where they cross tiles. ``min_d2``: squared distances below it are too
    near. Cells too near a ``blocked`` one are never taken. With ``n``, the first n of the set in that order: each
    keeps out at most those around it, so they are among the first n times as many. Null scores are left out.
    """
    near = [(y, x) for y, x, _ in offsets(min_d2 - 1)]
    todo = cells.where(F.col(score).isNotNull()).groupBy("r", "c").agg(F.max(score).alias("s"))
    if blocked is not None:
        todo = todo.join(spread(blocked.select("r", "c"), offsets(min_d2 - 1)).select("r", "c").distinct(), ["r", "c"], "left_anti")
    if n is not None:
        todo = todo.orderBy(F.desc("s"), "r", "c").limit(n * max(len(near), 1))
    kept = choose_in_order(todo, ["s", "r", "c"], math.isqrt(max(min_d2 - 1, 0)), lambda v: [near] * len(v), falling=("s",))
    out = cells.join(kept, ["r", "c"], "left_semi")
    return out if n is None else out.orderBy(F.desc(score), "r", "c").limit(n)


def _best_in_tile(rows: pd.DataFrame, reach: int, near: list[tuple[int, int]]) -> pd.DataFrame:
    """One tile of ``cover_greedily``: its candidates (r, c, gain, g, state), g the gain that orders them.

    state 1: taken, and no other tile can change that; -1: never taken; 0: left to a later round, g an upper bound.
    A candidate beyond the tile may or may not be taken when its turn comes, and so may all that it could have
    changed: these, and what they could have changed, are left.
    """
    tr, tc, halo = int(rows.tr.iloc[0]), int(rows.tc.iloc[0]), reach + 2
    r0, c0, size = tr * TILE - halo - 2, tc * TILE - halo - 2, TILE + 2 * halo + 4
    weight, cover, free = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size), bool)
    r, c = rows.r.to_numpy() - r0, rows.c.to_numpy() - c0
    fields = ~rows.candidate.to_numpy(dtype=bool)
    weight[r[fields], c[fields]], cover[r[fields], c[fields]] = rows.w.to_numpy(dtype=float)[fields], rows.cover.to_numpy(dtype=float)[fields]
    edge, last = halo + 2 - reach, halo + 2 + TILE + reach
    seen = ~fields & (r >= edge) & (r < last) & (c >= edge) & (c < last)
    free[r[seen], c[seen]] = True
    taps = [(y, x, max(1 - math.sqrt(d) / RADIUS, 0.0)) for y, x, d in KERNEL]

    def gain_of(y: int, x: int) -> float:
        return float(sum(weight[y + a, x + b] * max(k - cover[y + a, x + b], 0.0) for a, b, k in taps))

    gains = np.zeros((size, size))
    inner = slice(2, size - 2)
    for a, b, k in taps:
        at = (slice(2 + a, size - 2 + a), slice(2 + b, size - 2 + b))
        gains[inner, inner] += weight[at] * np.maximum(k - cover[at], 0.0)
    keys = np.round(gains, 10)
    queue = [(-keys[y, x], y, x) for y, x in zip(*(v.tolist() for v in np.nonzero(free)), strict=True)]
    heapq.heapify(queue)
    unsure, state = np.zeros((size, size), bool), np.zeros((size, size), np.int8)
    first, end = halo + 2, halo + 2 + TILE
    while queue:
        g, y, x = heapq.heappop(queue)
        if not free[y, x] or -g != keys[y, x]:
            continue
        free[y, x] = False
        if gains[y, x] <= 1e-12:
            state[y, x] = -1
        elif first <= y < end and first <= x < end and not unsure[y, x]:
            state[y, x] = 1
            for a, b, k in taps:
                cover[y + a, x + b] = max(cover[y + a, x + b], k)
            for a, b in near:
                if free[y + a, x + b]:
                    free[y + a, x + b], state[y + a, x + b] = False, -1
            for v in range(y - 4, y + 5):
                for w in range(x - 4, x + 5):
                    if 2 <= v < size - 2 and 2 <= w < size - 2 and free[v, w]:
                        gains[v, w] = gain_of(v, w)
                        now = round(gains[v, w], 10)
                        if now != keys[v, w]:
                            keys[v, w] = now
                            heapq.heappush(queue, (-now, v, w))
        else:
            unsure[max(y - reach, 0) : y + reach + 1, max(x - reach, 0) : x + reach + 1] = True
    own = seen & (r >= first) & (r < end) & (c >= first) & (c < end)
    r, c = r[own], c[own]
    return pd.DataFrame({"r": r + r0, "c": c + c0, "gain": gains[r, c], "g": keys[r, c], "state": state[r, c].astype(int)})


def cover_greedily(candidates: DataFrame, n: int | None = None, min_d2: int = 1, field: DataFrame | None = None) -> DataFrame:
    """(r, c, gain): greedy maximum coverage of a field (r, c, w) by at most ``n`` dots; by default the candidates' own.

    A candidate whose gain beats those of all others that could share a field cell with it is next in its
    surroundings whatever happens elsewhere; gains only fall, and the picks by falling gain are those of one global
    pass (ties in raster order). A round follows that pass in all tiles at once, in each as far as other tiles cannot
    change it. Rounds end when nothing is left to gain, or n picks come before all that is left. Dots nearer than
    ``min_d2`` to a dot are not taken.

    With ``n``, only the best candidates of the start can be taken: a pick changes what lies within ``reach``, so at
    most four of several that lie farther apart than it; of 4 (n - 1) + 1 such, one is as good as ever before each
    pick, and no pick is below the least of them. They are among the first of that number times what each is near.
    """
    field = stored((candidates if field is None else field).select("r", "c", "w").withColumn("cover", F.lit(0.0)))
    reach, near = max(4, math.isqrt(max(min_d2 - 1, 0))), offsets(min_d2 - 1)
    todo = candidates.select("r", "c").distinct()
    if n is not None:
        most = (2 * reach + 1) ** 2 * (4 * (n - 1) + 1)
        gains = gain_map(todo, field.select("r", "c", "w"), field.select("r", "c", "cover"))
        todo = gains.orderBy(F.desc(F.round("gain", 10)), "r", "c").limit(most).select("r", "c") if n > 0 else todo.limit(0)
    todo, kept = stored(todo), None
    shape = [(y, x) for y, x, _ in near]
    order = F.struct("g", (-F.col("r")).alias("a"), (-F.col("c")).alias("b"))
    while todo.head(1):
        both = field.select("r", "c", "w", "cover", F.lit(False).alias("candidate")).unionByName(todo.select("r", "c", F.lit(0.0).alias("w"), F.lit(0.0).alias("cover"), F.lit(True).alias("candidate")))
        live = todo.select(F.floor(F.col("r") / TILE).cast("int").alias("tr"), F.floor(F.col("c") / TILE).cast("int").alias("tc")).distinct()
        told = in_tiles(both, reach + 2).join(live, ["tr", "tc"]).groupBy("tr", "tc").applyInPandas(lambda rows: _best_in_tile(rows, reach, shape), "r int, c int, gain double, g double, state int")
        told = stored(told)
        won = told.where("state = 1").select("r", "c", "gain", "g")
        kept = won if kept is None else kept.unionByName(won)
        left = told.where("state = 0").select("r", "c", "g")
        if len(near) > 1:
            left = left.join(spread(won.select("r", "c"), near).select("r", "c").distinct(), ["r", "c"], "left_anti")
        old, todo = todo, stored(left)
        forget(old)
        if n is not None:
            top = todo.agg(F.max(order).alias("k")).first()["k"]
            sure = kept if top is None else kept.where((F.col("g") > top.g) | ((F.col("g") == top.g) & (F.struct("r", "c") < F.struct(F.lit(-top.a), F.lit(-top.b)))))
            if sure.count() >= n:
                break
        fresh = spread(won.select("r", "c"), KERNEL).groupBy("r", "c").agg(F.max(kernel(F.col("d2"))).alias("fresh"))
        last, field = field, stored(field.join(fresh, ["r", "c"], "left").select("r", "c", "w", F.greatest("cover", F.coalesce("fresh", F.lit(0.0))).alias("cover")))
        forget(last)
    if kept is None:
        return todo.select("r", "c", F.lit(0.0).alias("gain")).limit(0)
    first = kept if n is None else kept.orderBy(F.desc("g"), "r", "c").limit(n)
    return first.select("r", "c", "gain")


def cover_thin(mask: DataFrame, budget: int, share: float = 0.06) -> DataFrame:
    """``budget`` cells of a mask that cover it well, in batches: the best local gains first, gains updated between batches.

    A batch takes ``share`` of what is missing (rounded up) among cells whose gain is the largest of their 3 x 3
    surroundings, by falling gain, none touching another of the batch; without such, among all that gain. Batches
    go on until the budget is spent; fewer cells come back only if nothing gains.
    """
    todo = stored(mask.select("r", "c").distinct())
    size = todo.count()
    if budget >= size:
        return todo
    field = stored(spread(todo, KERNEL).select("r", "c").distinct().withColumn("w", F.lit(1.0)))
    cover, kept, taken = field.select("r", "c", F.lit(0.0).alias("cover")).limit(0), None, 0
    while taken < budget:
        gains = stored(gain_map(todo, field, cover).select("r", "c", F.round("gain", 9).alias("gain")).where("gain > 0"))
        around = spread(gains, offsets(2, 1)).groupBy("r", "c").agg(F.max("gain").alias("top"))
        peaks = gains.join(around, ["r", "c"], "left").where(F.col("top").isNull() | (F.col("gain") >= F.col("top"))).select("r", "c", "gain")
        batch = stored(spaced(peaks, "gain", 3, n=max(1, math.ceil((budget - taken) * share))).select("r", "c"))
        got = batch.count()
        if not got:
            break
        taken += got
        kept = batch if kept is None else kept.unionByName(batch)
        fresh = spread(batch, KERNEL).select("r", "c", kernel(F.col("d2")).alias("cover"))
        last, cover = cover, stored(cover.unionByName(fresh).groupBy("r", "c").agg(F.max("cover").alias("cover")))
        old, todo = todo, stored(todo.join(batch, ["r", "c"], "left_anti"))
        forget(last, old, gains)
    return todo.limit(0) if kept is None else kept


def thin_along(cells: DataFrame, along: int, across: int, seed: int | None = None) -> DataFrame:
    """Thinning where a kept dot blocks an ellipse: ``along`` its strike (degrees from the row axis), ``across`` it.

    cells: r, c, strike. A cell stays unless a kept cell before it blocks it, in raster order or, with a seed, in a
    hash-random order (md5 of seed and place, which any engine repeats). Rounds decide all cells that no undecided
    cell before them could block: no group holds a cluster. A random order needs few rounds at any size; raster
    order needs as many as the longest chain of cells that depend on each other.
    """
    reach = max(along, across)
    order = F.struct("r", "c") if seed is None else F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("c").cast("string"))).alias("h"), "r", "c")
    a = F.radians("strike")
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x, _ in offsets(reach * reach, 1)]))

    def blocks(df: DataFrame) -> DataFrame:
        moved = df.select("r", "c", "k", F.cos(a).alias("u"), F.sin(a).alias("v"), step.alias("o"))
        ahead, aside = F.col("o.y") * F.col("u") + F.col("o.x") * F.col("v"), F.col("o.x") * F.col("u") - F.col("o.y") * F.col("v")
        inside = ahead * ahead / along**2 + aside * aside / across**2 < 1 - 1e-9
        return moved.where(inside).select((F.col("r") + F.col("o.y")).alias("r"), (F.col("c") + F.col("o.x")).alias("c"), "k")

    todo, kept = stored(cells.select("r", "c", "strike", order.alias("k"))), None
    while todo.head(1):
        first = blocks(todo).groupBy("r", "c").agg(F.min("k").alias("first"))
        won = stored(todo.join(first, ["r", "c"], "left").where(F.col("first").isNull() | (F.col("k") < F.col("first"))).drop("first"))
        kept = won if kept is None else kept.unionByName(won)
        # a kept cell blocks only cells after it
        hit = blocks(won).groupBy("r", "c").agg(F.min("k").alias("first"))
        rest = todo.join(won.select("r", "c"), ["r", "c"], "left_anti").join(hit, ["r", "c"], "left")
        last, todo = todo, stored(rest.where(F.col("first").isNull() | (F.col("k") < F.col("first"))).drop("first"))
        forget(last)
    return cells.select("r", "c").limit(0) if kept is None else kept.select("r", "c")


def ridge_base(cells: DataFrame, score: str, share: float, min_d2: int, *by: str) -> DataFrame:
    """The dotted base: of each fold the highest share of cells (rounded, at least one), thinned by falling score."""
    size = cells.groupBy(*by).agg(F.greatest(F.rint(F.count(F.lit(1)) * share), F.lit(1.0)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "r", "c"))
    top = cells.withColumn("_place", place).join(F.broadcast(size), list(by)).where(F.col("_place") <= F.col("_n"))
    return spaced(top.select("r", "c", score, *by), score, min_d2)


def allocate_corridor(cells: DataFrame, score: str, catalogue: DataFrame, share: float, quantile: float, clearance_d2: int) -> DataFrame:
    """(r, c, gain): dots by greedy coverage of the highest scores, clear of a catalogue.

    Cells farther than the clearance are allowed; those at or above the quantile of the allowed scores, and above 0,
    are candidates, weighted by score; ``share`` of all cells (rounded) are dots.
    """
    n = round(cells.count() * share)
    allowed = near_distance(cells, catalogue, clearance_d2).where("d2 is null").select("r", "c", F.col(score).cast("double").alias("w"))
    candidates = quantile_cut(allowed, "w", quantile).where("w >= _cut and w > 0").select("r", "c", "w")
    return cover_greedily(candidates, n)


def random_spaced(cells: DataFrame, min_d2: int, seed: int, n: int | None = None) -> DataFrame:
    """A spaced set in hash-random order: the control of a scored one."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("c").cast("string")))
    return spaced(cells.select("r", "c").withColumn("draw", draw), "draw", min_d2, n=n).select("r", "c")


def packing_arms(pool: DataFrame, score: str, n: int, min_d2: int, seed: int) -> DataFrame:
    """(arm, r, c): n dots of a pool (r, c, score) packed by score, at random, and by coverage."""
    arms = {
        "score": spaced(pool, score, min_d2, n=n).select("r", "c"),
        "random": random_spaced(pool, min_d2, seed, n),
        "cover": cover_greedily(pool.select("r", "c", F.lit(1.0).alias("w")), n, min_d2).select("r", "c"),
    }
    out = None
    for arm, dots in arms.items():
        one = dots.select(F.lit(arm).alias("arm"), "r", "c")
        out = one if out is None else out.unionByName(one)
    return out


def quota_fill(parent: DataFrame, distance: str, candidates: DataFrame, registered: DataFrame, share: float, most: float, min_d2: int, seed: int) -> DataFrame:
    """(r, c, part): the parent's farthest share of dots, and a spaced random fill that respects each registered set's quota.

    registered: (f, r, c). A set's quota is ``most`` times the parent's dots, counting dots within 3 cells of the set.
    Fill rounds draw spaced candidates in hash order; of those near a set, the first that its quota still admits
    stay, the strictest set deciding; who is left out of a round is never drawn again. Fewer dots come back if the
    candidates run out.
    """
    total = parent.count()
    keep, cap = round(total * share), math.floor(most * total)
    kept = stored(parent.orderBy(F.desc(distance), "r", "c").limit(keep).select("r", "c"))
    near = stored(spread(registered.select("f", "r", "c"), WITHIN3).select("f", "r", "c").distinct())
    fill = stored(random_spaced(candidates.join(parent.select("r", "c"), ["r", "c"], "left_anti"), min_d2, seed))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("c").cast("string")))
    used = kept.join(near, ["r", "c"]).groupBy("f").agg(F.count(F.lit(1)).alias("used"))
    # in hash order, a dot is refused once a set near it is full; counting all dots before it, refused ones too, never exceeds a quota
    place = F.row_number().over(Window.partitionBy("f").orderBy("draw", "r", "c"))
    ranked = fill.withColumn("draw", draw).join(near, ["r", "c"]).withColumn("place", place).join(used, "f", "left")
    over = ranked.where(F.col("place") + F.coalesce("used", F.lit(0)) > cap).select("r", "c").distinct()
    fits = fill.join(over, ["r", "c"], "left_anti").withColumn("draw", draw).orderBy("draw", "r", "c").limit(total - keep)
    return kept.withColumn("part", F.lit("kept")).unionByName(fits.select("r", "c", F.lit("fill").alias("part")))


def relocate(dots: DataFrame, allowed: DataFrame) -> DataFrame:
    """(r, c, r0, c0): dots moved by their (dy, dx) where the target is allowed and free, else left in place.

    A target that several dots want goes to the first in raster order. A dot never moves onto a place that any
    dot holds at the start, so no move depends on another one's outcome.
    """
    want = dots.select(F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("r") + F.col("dy")).alias("r"), (F.col("c") + F.col("dx")).alias("c"))
    free = want.join(allowed.select("r", "c").distinct(), ["r", "c"], "left_semi").join(dots.select("r", "c"), ["r", "c"], "left_anti")
    moved = free.groupBy("r", "c").agg(F.min(F.struct("r0", "c0")).alias("k")).select("r", "c", "k.r0", "k.c0")
    stay = dots.select(F.col("r").alias("r0"), F.col("c").alias("c0")).join(moved.select("r0", "c0"), ["r0", "c0"], "left_anti")
    return moved.unionByName(stay.select(F.col("r0").alias("r"), F.col("c0").alias("c"), "r0", "c0"))


def swap_weakest(base: DataFrame, pool: DataFrame, score: str, share: float) -> DataFrame:
    """Base dots without their weakest share (floor), and as many of the best pool dots that are no base dots.

    Both cuts are bounded top-k selections, ties in raster order.
    """
    n = int(base.count() * share)
    weakest = base.orderBy(F.col(score), F.desc("r"), F.desc("c")).limit(n).select("r", "c")
    fresh = pool.join(base.select("r", "c"), ["r", "c"], "left_anti").orderBy(F.desc(score), "r", "c").limit(n)
    return base.join(weakest, ["r", "c"], "left_anti").select("r", "c", score).unionByName(fresh.select("r", "c", score))
