"""Joins by place on a grid.

A bounded radius is a short list of integer offsets, exploded on one side and equi-joined on (r, c): no
range join, no distance transform, and squared distances stay integers. An unbounded nearest neighbour
doubles its radius: both sides meet in tiles as wide as the radius, a match counts if it is within it, and
only rows without a match go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored


def offsets(most_d2: int, least_d2: int = 0) -> list[tuple[int, int, int]]:
    """(dy, dx, d2) with least_d2 <= d2 <= most_d2."""
    k = int(most_d2**0.5) + 1
    return [(y, x, y * y + x * x) for y in range(-k, k + 1) for x in range(-k, k + 1) if least_d2 <= y * y + x * x <= most_d2]


#: The kernel of radius 3 is positive on 25 offsets; 29 are within distance 3.
KERNEL = offsets(8)
WITHIN3 = offsets(9)


def square(k: int) -> list[tuple[int, int, int]]:
    return [(y, x, y * y + x * x) for y in range(-k, k + 1) for x in range(-k, k + 1)]


def spread(df: DataFrame, offs: list[tuple[int, int, int]]) -> DataFrame:
    """Each cell moved by each offset, with ``d2``; other columns are kept."""
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(d).alias("d2")) for y, x, d in offs]))
    rest = [c for c in df.columns if c not in ("r", "c", "d2")]
    moved = df.select("r", "c", *rest, step.alias("o"))
    return moved.select((F.col("r") + F.col("o.y")).alias("r"), (F.col("c") + F.col("o.x")).alias("c"), F.col("o.d2").alias("d2"), *rest)


def near_distance(cells: DataFrame, mask: DataFrame, most_d2: int, *by: str) -> DataFrame:
    """Adds ``d2`` to the nearest mask cell, null beyond the radius. ``by``: columns that must be equal too."""
    key = ["r", "c", *by]
    reach = spread(mask.select(*key).distinct(), offsets(most_d2)).groupBy(*key).agg(F.min("d2").alias("d2"))
    return cells.join(reach, key, "left")


def within(cells: DataFrame, mask: DataFrame, most_d2: int, *by: str) -> DataFrame:
    """Cells with a mask cell within the radius."""
    key = ["r", "c", *by]
    return cells.join(spread(mask.select(*key).distinct(), offsets(most_d2)).select(*key).distinct(), key, "left_semi")


def dilate8(mask: DataFrame, n: int) -> DataFrame:
    """Chebyshev dilation by n cells; n <= 0 changes nothing."""
    return mask.select("r", "c").distinct() if n <= 0 else spread(mask.select("r", "c"), square(n)).select("r", "c").distinct()


def shift(cells: DataFrame, dr: int, dc: int, value: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Adds the value of the neighbour at (r - dr, c - dc) of ``source``, else of the table; null where there is none.

    Chains of shifts give the source, so that each joins the plain table and not what came before.
    """
    other = (cells if source is None else source).select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col(value).alias(name))
    return cells.join(other, ["r", "c"], "left")


def convolve(cells: DataFrame, taps: list[tuple[int, int, float]], value: str, name: str) -> DataFrame:
    """Weighted sum over neighbours at (r + dy, c + dx); missing neighbours count as 0."""
    tap = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(float(w)).alias("w")) for y, x, w in taps]))
    moved = cells.select("r", "c", value, tap.alias("t")).select((F.col("r") - F.col("t.y")).alias("r"), (F.col("c") - F.col("t.x")).alias("c"), (F.col(value) * F.col("t.w")).alias("p"))
    return cells.join(moved.groupBy("r", "c").agg(F.sum("p").alias(name)), ["r", "c"], "left")


def nearest(left: DataFrame, right: DataFrame, extent: int, start: int = 8, least_d2: int = 0) -> DataFrame:
    """Adds ``d2`` and ``near`` (r, c and the other columns of ``right``) of the nearest row not nearer than ``least_d2``; ties by r, then c.

    ``extent`` bounds coordinates' differences. An empty right side gives nulls. Left rows keep their number. Of
    right rows at one place only the least can be the nearest one.
    """
    rest = [x for x in right.columns if x not in ("r", "c")]
    target = stored(right.groupBy("r", "c").agg(F.min(F.struct("r", "c", *rest)).alias("p")).select("p"))
    left = left.withColumn("_row", F.monotonically_increasing_id())
    todo, done, radius = stored(left), None, start
    left = todo
    while True:
        def tile(r: Column, c: Column) -> tuple[Column, Column]:
            return F.floor(r / radius), F.floor(c / radius)  # noqa: B023

        lr, lc = tile(F.col("r"), F.col("c"))
        rr, rc = tile(F.col("p.r"), F.col("p.c"))
        around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
        homes = target.select("p", rr.alias("tr"), rc.alias("tc"), around.alias("o")).select("p", (F.col("tr") + F.col("o.y")).alias("tr"), (F.col("tc") + F.col("o.x")).alias("tc"))
        d2 = F.pow(F.col("r") - F.col("p.r"), 2) + F.pow(F.col("c") - F.col("p.c"), 2)
        pairs = todo.select("_row", "r", "c", lr.alias("tr"), lc.alias("tc")).join(homes, ["tr", "tc"]).select("_row", d2.cast("long").alias("d2"), "p").where(F.col("d2").between(least_d2, radius * radius))
        hit = stored(pairs.groupBy("_row").agg(F.min(F.struct("d2", "p")).alias("m")).select("_row", "m.d2", F.col("m.p").alias("near")))
        done = hit if done is None else done.unionByName(hit)
        last, todo = todo, stored(todo.join(hit, "_row", "left_anti"))
        if last is not left:
            forget(last)
        if radius >= 2 * extent or not todo.head(1):
            forget(target)
            return left.join(done, "_row", "left").drop("_row")
        radius *= 2


def checked_dots(cells: DataFrame, value: str, least: float = 0.5) -> DataFrame:
    """Cells above ``least``. Any value that is null, NaN or outside 0..1 raises an error when the plan runs."""
    v = F.col(value)
    fine = F.coalesce(v.between(0, 1) & ~F.isnan(v), F.lit(False))
    checked = F.when(fine, v).otherwise(F.raise_error(F.lit("a value is missing or outside 0..1")).cast("double"))
    return cells.select("r", "c", checked.alias("_v")).where(F.col("_v") > least).select("r", "c")


def point_mask(points: DataFrame, height: int, width: int, clip: bool) -> DataFrame:
    """Distinct cells of points (r, c): strays are moved to the nearest edge cell, or left out."""
    if clip:
        points = points.select(F.least(F.greatest("r", F.lit(0)), F.lit(height - 1)).alias("r"), F.least(F.greatest("c", F.lit(0)), F.lit(width - 1)).alias("c"))
    return points.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select("r", "c").distinct()


def eligible_rows(rows: DataFrame, support: DataFrame, test: Column) -> DataFrame:
    """Rows that pass the test (null is no) and lie on supported cells. Ids must be unique: a repeated one raises an error."""
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("_again"))
    fine = F.when(F.col("_again") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("a cluster id occurs twice")).cast("boolean"))
    return rows.where(F.coalesce(test, F.lit(False))).join(support.select("r", "c").distinct(), ["r", "c"], "left_semi").join(F.broadcast(again), F.lit(True)).where(fine).drop("_again")


def design_matrix(cells: DataFrame, catalogue: DataFrame, height: int, width: int, reach: int, box: int) -> DataFrame:
    """Adds ``features``: distance to the catalogue (reach + 1 beyond it), its share of a box, and coordinates 0..1."""
    near = near_distance(cells, catalogue, reach * reach)
    inside = spread(catalogue.select("r", "c"), square(box)).groupBy("r", "c").agg(F.count(F.lit(1)).alias("_n"))
    both = near.join(inside, ["r", "c"], "left")
    distance = F.sqrt(F.coalesce("d2", F.lit((reach + 1) ** 2)))
    share = F.coalesce("_n", F.lit(0)) / (2 * box + 1) ** 2
    return both.withColumn("features", F.array(distance, share, F.col("r") / (height - 1), F.col("c") / (width - 1))).drop("d2", "_n")
