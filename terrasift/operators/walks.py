"""Breadth-first order of cells, and choosing cells in a given order, by rounds over tiles.

A round works in every tile at once and goes as far as the tile's halo allows, so rounds grow with the number of
tiles that a chain of cells crosses, not with its cells. No group holds more than a tile and its halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import kernel
from ..storage import forget, stored
from .components import label8
from .neighbours import KERNEL, offsets, spread
from .statistics import numbered

TILE = 192
#: Steps that a round of the walk takes; a step's direction is a digit of an order.
STEPS = 64
#: Neighbours in the order in which a walk looks at them.
AROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0)]


def in_tiles(cells: DataFrame, halo: int) -> DataFrame:
    """Cells with each tile (tr, tc) that they lie in or within the halo of."""
    near = lambda x: F.explode(F.sequence(F.floor((F.col(x) - halo) / TILE).cast("int"), F.floor((F.col(x) + halo) / TILE).cast("int")))
    return cells.select("*", near("r").alias("tr")).select("*", near("c").alias("tc"))


def breadth_first(mask: DataFrame, width: int) -> DataFrame:
    """(r, c, comp, level, group, code): a first-in-first-out walk of each component from its first cell in raster order.

    Sorted by (comp, level, group, code), cells come in the order in which one queue over the whole mask would hand
    them out: a cell's place among those of its level is that of the first neighbour to reach it, and then the
    direction. ``code`` spells the directions since the last round, ``group`` the place that its ancestor had then.
    """
    marked = stored(label8(mask.select("r", "c").distinct(), width))
    seeds = marked.where(F.col("r").cast("long") * width + F.col("c") == F.col("comp"))
    front = stored(seeds.select("r", "c", "comp", F.col("comp").alias("place")))
    done = stored(seeds.select("r", "c", "comp", F.lit(0).alias("level"), F.lit(0).cast("long").alias("group"), F.lit("").alias("code")))
    todo = stored(marked.join(front.select("r", "c"), ["r", "c"], "left_anti"))
    level = 0

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        own = lambda r, c: r // TILE == tr and c // TILE == tc
        start = pdf[pdf.place.notna()].sort_values(["comp", "place"])
        free = set(zip(pdf.r[pdf.place.isna()].tolist(), pdf.c[pdf.place.isna()].tolist(), strict=True))
        line = [(r, c, comp, int(p), "") for r, c, comp, p in zip(start.r, start.c, start.comp, start.place, strict=True)]
        out = []
        for step in range(1, STEPS + 1):
            following = []
            for r, c, comp, place, code in line:
                for k, (y, x) in enumerate(AROUND):
                    if (r + y, c + x) in free:
                        free.discard((r + y, c + x))
                        following.append((r + y, c + x, comp, place, code + str(k)))
            line = following
            out += [(r, c, comp, step, place, code) for r, c, comp, place, code in line if own(r, c)]
            if not line:
                break
        return pd.DataFrame(out, columns=["r", "c", "comp", "step", "group", "code"])

    while front.head(1):
        both = front.withColumn("place", F.col("place").cast("double")).unionByName(todo.withColumn("place", F.lit(None).cast("double")))
        # only tiles that the walk can enter in this round are looked at
        live = in_tiles(front.select("r", "c"), STEPS).select("tr", "tc").distinct()
        found = stored(in_tiles(both, STEPS).join(live, ["tr", "tc"]).groupBy("tr", "tc").applyInPandas(walk, "r int, c int, comp long, step int, group long, code string"))
        done_now = found.select("r", "c", "comp", (F.col("step") + level).alias("level"), "group", "code")
        done = done.unionByName(done_now)
        last, todo = todo, stored(todo.join(found.select("r", "c"), ["r", "c"], "left_anti"))
        edge = numbered(found.where(F.col("step") == STEPS).select("r", "c", "comp", "group", "code"), "comp", "group", "code", name="place")
        before, front = front, stored(edge.select("r", "c", "comp", "place"))
        forget(last, before)
        level += STEPS
    return done


def choose_in_order(cells: DataFrame, order: list[str], reach: int, blocks: Callable[[np.ndarray], list[list[tuple[int, int]]]], values: list[str] | None = None, falling: tuple[str, ...] = ()) -> DataFrame:
    """(r, c) of the cells that are kept if cells are taken by rising ``order`` unless one kept before blocks them.

    Columns of the order that are in ``falling`` are taken from their highest value on, NaN first as in Spark.

    ``blocks`` gets an array (a row a cell) of the columns ``values`` and returns the offsets, none longer than
    ``reach`` in either direction, that each cell blocks if it is kept. No two cells may be equal in ``order``. A
    round decides in every tile what cells of other tiles, still undecided, cannot change.
    """
    values = values or []
    names = [x for x in dict.fromkeys([*order, *values]) if x not in ("r", "c")]
    todo, kept = stored(cells.select("r", "c", *names)), None

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        pdf = pdf.sort_values(order, ascending=[x not in falling for x in order], na_position="first" if falling else "last")
        r, c = pdf.r.to_numpy(), pdf.c.to_numpy()
        own = (r // TILE == tr) & (c // TILE == tc)
        reached = blocks(pdf[values].to_numpy(dtype=float) if values else np.zeros((len(pdf), 0)))
        blocked: set[tuple[int, int]] = set()
        maybe: set[tuple[int, int]] = set()
        out = []
        for i, (y, x, mine, sure) in enumerate(zip(r.tolist(), c.tolist(), own.tolist(), pdf.sure.tolist(), strict=True)):
            if sure:
                blocked.update((y + a, x + b) for a, b in reached[i])
            elif (y, x) in blocked:
                if mine:
                    out.append((y, x, False))
            elif mine and (y, x) not in maybe:
                out.append((y, x, True))
                blocked.update((y + a, x + b) for a, b in reached[i])
            else:
                maybe.update((y + a, x + b) for a, b in reached[i])
        return pd.DataFrame(out, columns=["r", "c", "keep"])

    while todo.head(1):
        now = todo.withColumn("sure", F.lit(False))
        if kept is not None:
            now = now.unionByName(kept.withColumn("sure", F.lit(True)))
        live = todo.select(F.floor(F.col("r") / TILE).cast("int").alias("tr"), F.floor(F.col("c") / TILE).cast("int").alias("tc")).distinct()
        told = stored(in_tiles(now, reach).join(live, ["tr", "tc"]).groupBy("tr", "tc").applyInPandas(decide, "r int, c int, keep boolean"))
        fresh = stored(todo.join(told.where("keep").select("r", "c"), ["r", "c"], "left_semi").select("r", "c", *names))
        kept = fresh if kept is None else kept.unionByName(fresh)
        last, todo = todo, stored(todo.join(told.select("r", "c"), ["r", "c"], "left_anti"))
        forget(last, told)
    return cells.select("r", "c").limit(0) if kept is None else kept.select("r", "c")


WALK = ["comp", "level", "group", "code"]


def thin(mask: DataFrame, width: int, min_d2: int, walked: DataFrame | None = None) -> DataFrame:
    """Thinning in breadth-first order: a cell is kept unless a kept one lies nearer than the spacing (squared).

    ``walked`` is the mask's ``breadth_first``, for several spacings of one mask.
    """
    near = [(y, x) for y, x, _ in offsets(min_d2 - 1, 0)]
    walked = breadth_first(mask, width) if walked is None else walked
    return choose_in_order(walked, WALK, math.isqrt(min_d2 - 1) if min_d2 > 1 else 0, lambda v: [near] * len(v))


def ellipse(along: float, across: float) -> Callable[[np.ndarray], list[list[tuple[int, int]]]]:
    """Offsets within an ellipse about each strike (degrees from the row axis); a disc where it is undefined."""
    reach = math.ceil(max(along, across))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1].reshape(2, -1)

    def of(values: np.ndarray) -> list[list[tuple[int, int]]]:
        out = []
        for strike in values[:, 0]:
            if np.isnan(strike):
                inside = y * y + x * x < max(along, across) ** 2 - 1e-9
            else:
                u, v = math.cos(math.radians(strike)), math.sin(math.radians(strike))
                inside = ((y * u + x * v) / along) ** 2 + ((x * u - y * v) / across) ** 2 < 1 - 1e-9
            out.append(list(zip(y[inside].tolist(), x[inside].tolist(), strict=True)))
        return out

    return of


def thin_along(cells: DataFrame, width: int, along: float, across: float) -> DataFrame:
    """Breadth-first thinning where a kept cell blocks an ellipse about its strike (r, c, strike; null: a disc)."""
    walked = breadth_first(cells, width).join(cells.select("r", "c", F.col("strike").cast("double")), ["r", "c"])
    return choose_in_order(walked, WALK, math.ceil(max(along, across)), ellipse(along, across), ["strike"])


def rungs(most: float = 8.0) -> list[int]:
    """Squared distances that two cells can have, up to a distance: thinning changes at no other spacing."""
    k = int(most) + 1
    return sorted({a * a + b * b for a in range(k + 1) for b in range(k + 1) if 0 < a * a + b * b <= most * most + 1e-9})


def ladder(emission: DataFrame, stand_in: DataFrame, width: int, spacings: list[int]) -> DataFrame:
    """(min_d2, dots, stand_dots, retention): what thinning to each spacing leaves of an emission and of a known network.

    Retention is the share of the network's own credit that its dots keep: the mean kernel value of its cells.
    """
    walks = [stored(breadth_first(m, width)) for m in (emission, stand_in)]
    all_cells = stand_in.select("r", "c").distinct()
    size = all_cells.agg(F.count(F.lit(1)).alias("size"))
    out = None
    for d2 in spacings:
        dots, stand = (stored(thin(m, width, d2, w)) for m, w in zip((emission, stand_in), walks, strict=True))
        credit = spread(stand, KERNEL).groupBy("r", "c").agg(F.max(kernel(F.col("d2"))).alias("k")).join(all_cells, ["r", "c"], "left_semi").agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("credit"))
        one = dots.agg(F.lit(d2).alias("min_d2"), F.count(F.lit(1)).alias("dots")).join(stand.agg(F.count(F.lit(1)).alias("stand_dots")), F.lit(True)).join(credit, F.lit(True)).join(size, F.lit(True))
        one = one.select("min_d2", "dots", "stand_dots", F.when(F.col("size") > 0, F.col("credit") / F.col("size")).alias("retention"))
        out = one if out is None else out.unionByName(one)
    return out


def predicted_score(credit: float | np.ndarray, truth: float, dots: float | np.ndarray, inside: float) -> float | np.ndarray:
    """Score of an emission of so many dots that earns a credit, if a share of its dots is inside the truth's kernel."""
    return credit / (0.8 * truth + 0.2 * (1 - inside) * dots + 0.2 * credit)


def fit_operating_point(steps: DataFrame, anchors: dict[int, float], inside: float) -> tuple[float, float, list[dict]]:
    """Credit of the solid emission, size of the truth, and each anchor's leave-one-out error, from scores of a ladder.

    ``anchors`` are known scores by spacing. The first two give a start in closed form; Gauss-Newton steps take all in.
    A row of the ladder for each anchor is all that reaches the driver. ValueError where anchors tell nothing apart.
    """
    rows = {r.min_d2: r for r in steps.where(F.col("min_d2").isin(list(anchors))).collect()}
    at = [(rows[d].retention, rows[d].dots, s) for d, s in anchors.items()]

    def fit(points: list[tuple]) -> np.ndarray:
        r, n, s = np.array(points, float).T
        a = np.stack([r * (1 - 0.2 * s), -0.8 * s], 1)
        x, _, rank, _ = np.linalg.lstsq(a, 0.2 * (1 - inside) * s * n, rcond=1e-12)
        if rank < 2:
            raise ValueError("anchors of equal score per retention")
        for _ in range(20):
            off = predicted_score(x[0] * r, x[1], n, inside) - s
            h = np.maximum(np.abs(x), 1.0) * 1e-6
            slope = np.stack([(predicted_score((x[0] + h[0]) * r, x[1], n, inside) - s - off) / h[0], (predicted_score(x[0] * r, x[1] + h[1], n, inside) - s - off) / h[1]], 1)
            x = x - np.linalg.lstsq(slope, off, rcond=None)[0]
        return x

    left_out = []
    for k, (d, s) in enumerate(anchors.items()):
        rest = at[:k] + at[k + 1 :]
        if len(rest) < 2:
            continue
        try:
            x = fit(rest)
        except ValueError:
            continue
        left_out.append({"min_d2": d, "score": s, "predicted": float(predicted_score(x[0] * at[k][0], x[1], at[k][1], inside)), "credit": float(x[0]), "truth": float(x[1])})
    credit, truth = fit(at)
    return float(credit), float(truth), left_out


def with_predictions(steps: DataFrame, credit: float | None, truth: float | None, inside: float) -> DataFrame:
    """Adds to a ladder the predicted score of each spacing, and whether going on to the next one is worth it.

    It is if less credit is lost for each dot that goes than the score at the spacing charges for it. Without a
    fitted credit and truth both are null.
    """
    credit, truth = (F.lit(x).cast("double") for x in (credit, truth))
    earned = F.col("retention") * credit
    score = earned / (0.8 * truth + 0.2 * (1 - inside) * F.col("dots") + 0.2 * earned)
    more = steps.select(F.col("min_d2").alias("_next"), F.col("dots").alias("_dots"), F.col("retention").alias("_kept"))
    pairs = steps.join(more, F.col("_next") > F.col("min_d2"), "left").groupBy(*steps.columns).agg(F.min_by(F.struct("_dots", "_kept"), "_next").alias("n"))  # a ladder has few rows
    lost = credit * F.abs(F.col("n._kept") - F.col("retention")) / F.nullif(F.abs(F.col("n._dots") - F.col("dots")), F.lit(0))
    return pairs.select(*steps.columns, score.alias("score"), (lost < 0.2 * score / (1 - 0.2 * score)).alias("go_on"))
