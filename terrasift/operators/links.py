"""Range joins between ends, dots, segments and sites, by tile buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_turn
from .neighbours import offsets, spread, square


def tile_pairs(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Pairs (columns of a as a_*, of b as b_*, d2) within the radius: both meet in tiles as wide as it."""
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
    left = a.select(*[F.col(x).alias(f"a_{x}") for x in a.columns]).withColumn("tr", F.floor(F.col("a_r") / radius)).withColumn("tc", F.floor(F.col("a_c") / radius))
    right = b.select(*[F.col(x).alias(f"b_{x}") for x in b.columns], around.alias("o"))
    right = right.withColumn("tr", F.floor(F.col("b_r") / radius) + F.col("o.y")).withColumn("tc", F.floor(F.col("b_c") / radius) + F.col("o.x")).drop("o")
    dr, dc = F.col("b_r") - F.col("a_r"), F.col("b_c") - F.col("a_c")
    return left.join(right, ["tr", "tc"]).drop("tr", "tc").withColumn("d2", (dr * dr + dc * dc).cast("long")).where(F.col("d2") <= radius * radius)


def cone_links(ends: DataFrame, pixels: DataFrame, radius: int, least_d2: int, cone_cos: float) -> DataFrame:
    """Each end's nearest pixel of another component inside the cone about its heading, if not nearer than allowed.

    ends: r, c, comp, ty, tx (unit heading); pixels: r, c, comp. Ties by r, then c.
    """
    pairs = tile_pairs(ends, pixels, radius).where(F.col("a_comp") != F.col("b_comp"))
    dot = (F.col("b_r") - F.col("a_r")) * F.col("a_ty") + (F.col("b_c") - F.col("a_c")) * F.col("a_tx")
    inside = pairs.where((F.col("d2") > 0) & (dot >= cone_cos * F.sqrt("d2") - 1e-9))
    best = inside.groupBy("a_r", "a_c", "a_comp").agg(F.min(F.struct("d2", "b_r", "b_c", "b_comp")).alias("q"))
    return best.where(F.col("q.d2") >= least_d2).select(F.col("a_r").alias("r"), F.col("a_c").alias("c"), F.col("a_comp").alias("comp_src"), F.col("q.b_r").alias("q_r"), F.col("q.b_c").alias("q_c"), F.col("q.b_comp").alias("comp_tgt"), F.col("q.d2").alias("d2"))


def _at_places(found: DataFrame, points: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of points (id, ...) with what was found for the place and kind (a_...) that each of them is at."""
    same = [points[x].eqNullSafe(found[f"a_{x}"]) for x in kinds]
    return points.join(found, same).withColumn("a_id", F.col("id"))


def weighted_share(points: DataFrame, sites: DataFrame, radius: int, agree: Column, decay: float) -> DataFrame:
    """Per point the share, by weight exp(-d / decay), of sites within the radius that agree.

    Points that differ only in their id, and sites that do, meet once, so that pairs grow with places and kinds.
    """
    own, theirs = ([x for x in t.columns if x != "id"] for t in (points, sites))
    w = F.exp(-F.sqrt("d2") / decay) * F.col("b__many")
    pairs = tile_pairs(points.select(*own).distinct(), sites.groupBy(*theirs).agg(F.count(F.lit(1)).alias("_many")), radius)
    found = pairs.groupBy(*[f"a_{x}" for x in own]).agg(F.sum(F.when(agree, w).otherwise(0.0)).alias("_good"), F.sum(w).alias("_all"), F.sum("b__many").alias("_n"))
    return _at_places(found, points, own).groupBy("a_id").agg((F.sum("_good") / F.greatest(F.sum("_all"), F.lit(1e-12))).alias("share"), F.sum("_n").alias("n"))


def borrow(points: DataFrame, segments: DataFrame, radius: int, agree: Column, value: str, k: int = 3) -> DataFrame:
    """Inverse-distance mean of a value over the k nearest agreeing segments; ties by segment id.

    Points that differ only in their id meet segments once, and of segments that differ only in id and value the k
    first, for no later one can be among the k nearest: pairs grow with places and kinds, not with rows. ``agree``
    does not look at ids or the value. A segment's rows are looked at again, all of them, for the value.
    """
    own, theirs = [x for x in points.columns if x != "id"], [x for x in segments.columns if x not in ("id", value)]
    place = F.dense_rank().over(Window.partitionBy(*theirs).orderBy("id"))
    first = segments.select("id", *theirs).distinct().withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    spot = [f"a_{x}" for x in own]
    near = tile_pairs(points.select(*own).distinct(), first, radius).where(agree).groupBy(*spot, "b_id").agg(F.min("d2").alias("d2"))
    # ranked in parts first, so that no task sorts all candidates of a point
    part = near.withColumn("part", F.pmod(F.xxhash64("b_id"), F.lit(64)))
    for by in ([*spot, "part"], spot):
        part = part.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("d2", "b_id"))).where(F.col("place") <= k)
    # the least value of a chosen segment's rows within the radius
    rows = part.select(*spot, "b_id", "d2").withColumnRenamed("d2", "_d2").join(segments.select(*[F.col(x).alias(f"b_{x}") for x in segments.columns]), "b_id")
    dr, dc = F.col("b_r") - F.col("a_r"), F.col("b_c") - F.col("a_c")
    rows = rows.withColumn("d2", (dr * dr + dc * dc).cast("long")).where((F.col("d2") <= radius * radius) & agree)
    valued = rows.groupBy(*spot, "b_id", F.col("_d2").alias("d2")).agg(F.min(f"b_{value}").alias("v"))
    found = valued.groupBy(*spot).agg(F.collect_list(F.struct("d2", "b_id", "v")).alias("s"))
    # rows of one id at several places share its k nearest
    each = _at_places(found, points, own).select("a_id", F.explode("s").alias("s")).select("a_id", "s.*").groupBy("a_id", "b_id").agg(F.min("d2").alias("d2"), F.min("v").alias("v"))
    best = each.groupBy("a_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "b_id", "v"))), 1, k).alias("s"))
    w = lambda x: 1 / (F.sqrt(x["d2"]) + 1)
    top = F.aggregate("s", F.lit(0.0), lambda a, x: a + w(x) * x["v"])
    low = F.aggregate("s", F.lit(0.0), lambda a, x: a + w(x))
    return best.select("a_id", (top / low).alias(value), F.size("s").alias("n"))


def mutual_pairs(links: DataFrame, tolerance: int) -> DataFrame:
    """One of each pair of links A-B and B-A whose ends lie within the tolerance: the lesser by (r, c, q_r, q_c)."""
    other = links.select(F.col("q_r").alias("r"), F.col("q_c").alias("c"), F.struct("r", "c", "q_r", "q_c").alias("m"))
    pairs = tile_pairs(links.select("r", "c", "q_r", "q_c"), other, 2 * max(tolerance, 1))
    mine = F.struct(F.col("a_r").alias("r"), F.col("a_c").alias("c"), F.col("a_q_r").alias("q_r"), F.col("a_q_c").alias("q_c"))
    back = F.greatest(F.abs(F.col("b_m.r") - F.col("a_q_r")), F.abs(F.col("b_m.c") - F.col("a_q_c"))) <= tolerance
    ahead = F.greatest(F.abs(F.col("b_r") - F.col("a_r")), F.abs(F.col("b_c") - F.col("a_c"))) <= tolerance
    worse = pairs.where(back & ahead & (F.col("b_m") < mine)).select(F.col("a_r").alias("r"), F.col("a_c").alias("c"), F.col("a_q_r").alias("q_r"), F.col("a_q_c").alias("q_c")).distinct()
    return links.join(worse, ["r", "c", "q_r", "q_c"], "left_anti")


def outward(labelled: DataFrame, ends: DataFrame, reach: int) -> DataFrame:
    """Adds dy, dx: the unit vector from the mean of an end's own component within a square to the end; 0, 0 for a lone cell."""
    near = spread(labelled.select("r", "c", "comp", F.col("r").alias("pr"), F.col("c").alias("pc")), square(reach)).select("r", "c", "comp", "pr", "pc")
    mean = ends.join(near, ["r", "c", "comp"]).groupBy("r", "c").agg(F.avg("pr").alias("mr"), F.avg("pc").alias("mc"), F.count(F.lit(1)).alias("n"))
    y, x = F.col("r") - F.col("mr"), F.col("c") - F.col("mc")
    size = F.sqrt(y * y + x * x)
    fine = (F.col("n") >= 2) & (size > 1e-9)
    return ends.join(mean, ["r", "c"]).withColumn("dy", F.when(fine, y / size).otherwise(0.0)).withColumn("dx", F.when(fine, x / size).otherwise(0.0)).drop("mr", "mc", "n")


def marker_offsets(ends: DataFrame, valid: DataFrame, gap: tuple[float, float], offset: tuple[float, float], strike_tolerance: float, heading_cos: float) -> DataFrame:
    """Pairs of ends of different components that look like one line, displaced: (r0, c0, r1, c1, gap, offset, turn).

    ends: r, c, comp, strike, dy, dx (unit heading outward). The step between them, along and across their mean
    strike, lies within ``gap`` and ``offset``; strikes differ by at most the tolerance; each end heads for the
    other; and all cells of the straight line between them are valid. r0, c0 is the end first in raster order.
    """
    radius = math.ceil(gap[1] + offset[1])
    pairs = tile_pairs(ends, ends, radius).where((F.struct("a_r", "a_c") < F.struct("b_r", "b_c")) & (F.col("a_comp") != F.col("b_comp")))
    y, x = (F.col("b_r") - F.col("a_r")).cast("double"), (F.col("b_c") - F.col("a_c")).cast("double")
    size = F.sqrt("d2")
    angle = F.radians((F.col("a_strike") + F.col("b_strike")) / 2)
    along = F.abs(y * F.sin(angle) + x * F.cos(angle))
    aside = F.abs(x * F.sin(angle) - y * F.cos(angle))
    turn = half_turn(F.col("a_strike"), F.col("b_strike"))
    fits = (turn <= strike_tolerance) & along.between(*gap) & aside.between(*offset)
    heads = (F.col("a_dy") * y + F.col("a_dx") * x >= heading_cos * size) & (F.col("b_dy") * y + F.col("b_dx") * x <= -heading_cos * size)
    good = pairs.where(fits & heads).select(F.col("a_r").alias("r0"), F.col("a_c").alias("c0"), F.col("b_r").alias("r1"), F.col("b_c").alias("c1"), along.alias("gap"), aside.alias("offset"), turn.alias("turn"), F.greatest(F.rint(size), F.lit(1.0)).cast("int").alias("n"))
    i = F.explode(F.sequence(F.lit(0), F.col("n")))
    path = good.select("r0", "c0", "r1", "c1", "n", i.alias("i")).select("r0", "c0", "r1", "c1", F.rint(F.col("r0") + (F.col("r1") - F.col("r0")) * F.col("i") / F.col("n")).cast("int").alias("r"), F.rint(F.col("c0") + (F.col("c1") - F.col("c0")) * F.col("i") / F.col("n")).cast("int").alias("c"))
    broken = path.join(valid.select("r", "c"), ["r", "c"], "left_anti").select("r0", "c0", "r1", "c1").distinct()
    return good.drop("n").join(broken, ["r0", "c0", "r1", "c1"], "left_anti")


def link_dots(chosen: DataFrame, base: DataFrame, labelled: DataFrame, spacing: int = 3) -> DataFrame:
    """Links (r, c, q_r, q_c) with dots (every ``spacing`` steps, ends left out), how many lie within 3 of the base, their share, and ``third``.

    ``third`` says that the link, three steps from its ends, touches a component (r, c, comp) that is neither end's.
    """
    n = F.greatest(F.abs(F.col("q_r") - F.col("r")), F.abs(F.col("q_c") - F.col("c")))
    at = lambda a, b: F.rint(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")).cast("int")
    key = ["e_r", "e_c", "q_r", "q_c"]
    path = chosen.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).select(F.col("r").alias("e_r"), F.col("c").alias("e_c"), "q_r", "q_c", "n", "i", at("r", "q_r").alias("pr"), at("c", "q_c").alias("pc")).withColumnsRenamed({"pr": "r", "pc": "c"})
    dots = path.where((F.col("i") % spacing == 0) & (F.col("i") > 0) & (F.col("i") < F.col("n"))).join(labelled.select("r", "c"), ["r", "c"], "left_anti")
    near = spread(base.select("r", "c"), offsets(8)).select("r", "c").distinct().withColumn("hit", F.lit(1))
    count = dots.join(near, ["r", "c"], "left").groupBy(*key).agg(F.count(F.lit(1)).alias("dots"), F.count("hit").alias("near_base"))
    own = lambda r, c, name: labelled.select(F.col("r").alias(r), F.col("c").alias(c), F.col("comp").alias(name))
    inner = path.where((F.col("i") >= 3) & (F.col("i") <= F.col("n") - 3)).join(own("e_r", "e_c", "src"), ["e_r", "e_c"], "left").join(own("q_r", "q_c", "tgt"), ["q_r", "q_c"], "left")
    met = spread(inner.select(*key, "src", "tgt", "r", "c"), square(1)).join(labelled, ["r", "c"]).where("comp <> src and comp <> tgt").select(*key).distinct().withColumn("third", F.lit(True))
    out = chosen.select(F.col("r").alias("e_r"), F.col("c").alias("e_c"), "q_r", "q_c").join(count, key, "left").join(met, key, "left")
    dots, shared = F.coalesce("dots", F.lit(0)).cast("long"), F.coalesce("near_base", F.lit(0)).cast("long")
    return out.select(*key, dots.alias("dots"), shared.alias("near_base"), F.round(shared / F.greatest(dots, F.lit(1)), 3).alias("base_share"), F.coalesce("third", F.lit(False)).alias("third"))
