"""Forests of links: Euler tours ranked by pointer doubling, ancestors, least covers, and what each link is worth.

Nothing here depends on how large a component or a node's degree is: tours, ancestors and covers are equi-joins on
nodes and arcs, sums over subtrees are differences of running sums over ranges.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .components import components
from .graph import least_forest
from .statistics import numbered

_FAR = 1 << 62


class Rooted(NamedTuple):
    """``nodes``: node, root, parent (null for roots), edge, enters, leaves; ``arcs``: node, place, down of the tour."""

    nodes: DataFrame
    arcs: DataFrame


def _inside(enters: str, leaves: str, other_enters: str, other_leaves: str) -> Column:
    """Whether the node of the first two lies at or above that of the last two."""
    return (F.col(enters) <= F.col(other_enters)) & (F.col(leaves) >= F.col(other_leaves))


def rooted(forest: DataFrame) -> Rooted:
    """A forest (edge, a, b) hung from the least node of each tree.

    The tour of a tree leaves a node by the arc after the one it came in by. Its arcs are ranked by pointers to later
    arcs, which reach four times as far each round, so rounds grow with the logarithm of the largest tree.
    """
    ends = F.array(*[F.struct((F.col("edge") * 2 + i).alias("arc"), F.col(x).alias("src"), F.col(y).alias("dst")) for i, (x, y) in enumerate((("a", "b"), ("b", "a")))])
    arcs = stored(numbered(forest.select(F.explode(ends).alias("e")).select("e.*"), "src", "arc", name="place"))
    first = stored(arcs.groupBy("src").agg(F.min("place").alias("first"), F.min_by("arc", "place").alias("first_arc")))
    at = arcs.select((F.col("place") - 1).alias("place"), F.col("src").alias("next_src"), F.col("arc").alias("next_arc"))
    around = arcs.join(at, "place", "left").join(first, "src")
    around = around.select(F.col("arc").bitwiseXOR(F.lit(1)).alias("arc"), F.when(F.col("next_src") == F.col("src"), F.col("next_arc")).otherwise(F.col("first_arc")).alias("next"))
    roots = stored(components(forest.select("a", "b")))
    opening = roots.where("node = root").join(first, F.col("node") == F.col("src")).select(F.col("first_arc").alias("opens"))
    now = around.join(opening, F.col("next") == F.col("opens"), "left").select("arc", F.when(F.col("opens").isNull(), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left"))
    now = stored(now)
    while now.where("next is not null").head(1):
        on = now
        for _ in range(3):
            hop = now.select(F.col("arc").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
            on = on.join(hop, "next", "left").select("arc", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        last, now = now, stored(on)
        forget(last)
    timed = arcs.join(now.select("arc", (-F.col("left")).alias("time")), "arc").join(now.select(F.col("arc").bitwiseXOR(F.lit(1)).alias("arc"), (-F.col("left")).alias("back")), "arc")
    timed = stored(timed.select("arc", "src", "dst", "time", "back", (F.col("time") < F.col("back")).alias("down")))
    below = timed.where("down").select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.shiftright("arc", 1).alias("edge"), F.col("time").alias("enters"), F.col("back").alias("leaves"))
    nodes = roots.join(below, "node", "left").select("node", "root", "parent", "edge", F.coalesce("enters", F.lit(-_FAR)).alias("enters"), F.coalesce("leaves", F.lit(_FAR)).alias("leaves"))
    tour = timed.select(F.when(F.col("down"), F.col("dst")).otherwise(F.col("src")).alias("node"), F.col("time").alias("place"), "down")
    forget(now, first)
    return Rooted(stored(nodes), tour)


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """(node, above, enters, leaves) of the ancestor 1, 2, 4, ... steps up, for nodes that have one; until none has."""
    place = nodes.select(F.col("node").alias("above"), "enters", "leaves")
    out = [stored(nodes.where("parent is not null").select("node", F.col("parent").alias("above")).join(place, "above").select("node", "above", "enters", "leaves"))]
    while True:
        last = out[-1]
        up = stored(last.select("node", F.col("above").alias("middle")).join(last.withColumnRenamed("node", "middle"), "middle").select("node", "above", "enters", "leaves"))
        if not up.head(1):
            return out
        out.append(up)


def least_covers(tree: Rooted, others: DataFrame) -> DataFrame:
    """(node, cover): the least key of the links (key, a, b) whose path in the tree runs over the edge above a node.

    A path climbs from both ends in steps of powers of two; keys noted for long steps are handed down to their halves.
    """
    place = tree.nodes.select("node", "enters", "leaves")
    ups = ancestors(tree.nodes)
    both = others.where("a <> b").select("key", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("key", "e.*")
    own = place.select(F.col("node").alias("u"), F.col("enters").alias("ue"), F.col("leaves").alias("ul"))
    far = place.select(F.col("node").alias("v"), F.col("enters").alias("ve"), F.col("leaves").alias("vl"))
    climb = both.join(own, "u").join(far, "v").where(~_inside("ue", "ul", "ve", "vl")).withColumn("steps", F.array().cast("array<struct<k:int,u:bigint>>"))
    for k in range(len(ups) - 1, -1, -1):
        up = ups[k].select(F.col("node").alias("u"), "above", "enters", "leaves")
        step = F.col("above").isNotNull() & ~_inside("enters", "leaves", "ve", "vl")
        noted = F.concat("steps", F.array(F.struct(F.lit(k).alias("k"), F.col("u").cast("long").alias("u"))))
        climb = climb.join(up, "u", "left").select("key", "v", "ve", "vl", F.when(step, F.col("above")).otherwise(F.col("u")).alias("u"), F.when(step, noted).otherwise(F.col("steps")).alias("steps"))
    last = F.array(F.struct(F.lit(0).alias("k"), F.col("u").cast("long").alias("u")))
    noted = stored(climb.select("key", F.explode(F.concat("steps", last)).alias("s")).groupBy("s.k", F.col("s.u").alias("node")).agg(F.min("key").alias("cover")))
    cover = noted.where(F.col("k") == len(ups) - 1).select("node", "cover")
    for k in range(len(ups) - 2, -1, -1):
        halves = cover.join(ups[k].select("node", "above"), "node").select(F.explode(F.array("node", "above")).alias("node"), "cover")
        cover = halves.unionByName(noted.where(F.col("k") == k).select("node", "cover")).groupBy("node").agg(F.min("cover").alias("cover"))
    cover = stored(cover.groupBy("node").agg(F.min("cover").alias("cover")))
    forget(noted, *ups)
    return cover


def bridges(links: DataFrame) -> DataFrame:
    """Adds ``bridge`` to links (a, b, ...): whether losing it parts its component. Parallel links and loops are none.

    A bridge is a link of a spanning forest whose edge no other link's path runs over.
    """
    keyed = stored(numbered(links, "a", "b", name="_key"))
    found = _forest(keyed.select(F.col("_key").alias("key"), "a", "b"))
    sure = found.where("cover is null").select(F.col("key").alias("_key"), F.lit(True).alias("_sure"))
    return keyed.join(sure, "_key", "left").select(*links.columns, F.coalesce("_sure", F.lit(False)).alias("bridge"))


def _forest(links: DataFrame, tree: list | None = None) -> DataFrame:
    """(key, node, cover) of the least spanning forest of links (key, a, b): the node below each, the least key that could replace it."""
    edges = stored(least_forest(links.select("a", "b", F.col("key").alias("gap"))).select(F.col("gap").cast("long").alias("edge"), "a", "b"))
    hung = rooted(edges)
    if tree is not None:
        tree.append(hung)
    cover = least_covers(hung, links.join(edges.select(F.col("edge").alias("key")), "key", "left_anti"))
    return hung.nodes.where("parent is not null").join(cover, "node", "left").select(F.col("edge").alias("key"), "node", "cover")


def connectivity_of_one(exponent: float, dimension: float, shortest: float, side: float) -> float:
    """Connectivity parameter of one system above the shortest length; the parameter is that times their number.

    The density of systems is that which a power law of the exponent, over a fractal of the dimension, needs for one
    system above ``shortest`` in a domain of the side.
    """
    density = (exponent - 1) * shortest ** (exponent - 1) / side**dimension
    e = dimension + 1 - exponent
    if abs(e) < 1e-9:
        return density * (math.log(side / shortest) + 1 / dimension)
    return density * (dimension * side**e / (e * (exponent - 1)) - shortest**e / e)


def link_values(systems: DataFrame, links: DataFrame, shortest: float, one: float) -> DataFrame:
    """What each link (a, b, gap, ...) between systems (node, length) is worth to the network that all links make.

    Links are closed by rising gap (ties by ends); one that joins two systems adds its gap to their length, others
    add nothing. Adds merged (length of both ends' systems and the gap), bridge, and the changes that losing the link
    makes, with the next best link closed instead where there is one: connectivity (number of systems of at least
    ``shortest`` times ``one``), share of the longest system, second moment of lengths; and rank, by the size of
    these: connectivity, then second moment, then merged. Losing a link that joins nothing changes nothing.
    """
    keyed = stored(numbered(links, "gap", "a", "b", name="_key"))
    held: list = []
    found = stored(_forest(keyed.select(F.col("_key").alias("key"), "a", "b"), held))
    tree: Rooted = held[0]
    gap = keyed.select(F.col("_key").alias("key"), "gap")
    length = systems.select("node", F.col("length").cast("double").alias("length"))
    # sums over subtrees: what the tour adds on its way down, between a node's two arcs
    weight = found.join(gap, "key").join(length, "node", "left").select("node", F.col("gap").alias("own_gap"), F.coalesce("length", F.lit(0.0)).alias("own"))
    tour = tree.arcs.join(tree.nodes.select("node", "root"), "node").join(weight, "node")
    tour = numbered(tour.withColumn("w", F.when(F.col("down"), F.col("own") + F.col("own_gap")).otherwise(0.0)), "root", "place", name="n", sums={"w": "upto"})
    below = tour.groupBy("node").agg((F.sum(F.when(F.col("down"), F.col("own") - F.col("upto")).otherwise(F.col("upto")))).alias("below"))
    tied = found.join(gap, "key").join(tree.nodes.select("node", "root"), "node")
    gaps = tied.groupBy("root").agg(F.sum("gap").alias("gaps"))
    named = systems.select(F.col("node"), F.col("length").cast("double").alias("length")).join(tree.nodes.select("node", "root"), "node", "left").select(F.coalesce("root", "node").alias("root"), "length")
    whole = stored(named.groupBy("root").agg(F.sum("length").alias("sum")).join(gaps, "root", "left").select("root", (F.col("sum") + F.coalesce("gaps", F.lit(0.0))).alias("whole")).where("whole > 0"))
    top = whole.orderBy(F.desc("whole")).limit(2).agg(F.max("whole").alias("_first"), F.when(F.count(F.lit(1)) > 1, F.min("whole")).otherwise(0.0).alias("_second"))
    sums = whole.agg(F.sum("whole").alias("_total"), F.count_if(F.col("whole") >= shortest).alias("_many"), F.sum(F.col("whole") * F.col("whole")).alias("_square"))
    one_row = F.broadcast(top.join(sums, F.lit(True)))
    edge = tied.join(below, "node").join(whole, "root").join(gap.select(F.col("key").alias("cover"), F.col("gap").alias("next_gap")), "cover", "left").join(one_row, F.lit(True))
    parts = F.when(F.col("cover").isNull(), F.array(F.col("below"), F.col("whole") - F.col("below") - F.col("gap"))).otherwise(F.array(F.col("whole") - F.col("gap") + F.col("next_gap")))
    edge = edge.withColumn("parts", F.filter(parts, lambda x: x > 0))
    total = F.col("_total") - F.col("whole") + F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    longest = F.greatest(F.when(F.col("whole") < F.col("_first"), F.col("_first")).otherwise(F.col("_second")), F.coalesce(F.array_max("parts"), F.lit(0.0)))
    many = F.when(F.col("whole") >= shortest, 1).otherwise(0) - F.size(F.filter("parts", lambda x: x >= shortest))
    square = F.col("whole") * F.col("whole") - F.aggregate("parts", F.lit(0.0), lambda a, x: a + x * x)
    share = F.col("_first") / F.col("_total") - F.when(total > 0, longest / total).otherwise(0.0)
    worth = edge.select(F.col("key").alias("_key"), F.col("cover").isNull().alias("_b"), (many * one).alias("_p"), share.alias("_s"), square.alias("_m"))
    side = lambda x: length.select(F.col("node").alias(x), F.col("length").alias(f"_{x}"))
    merged = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b_len", F.lit(0.0)) + F.col("gap")).alias("merged")
    out = keyed.join(side("a"), "a", "left").join(side("b").withColumnRenamed("_b", "_b_len"), "b", "left").join(worth, "_key", "left")
    nothing = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.select(*links.columns, "_key", merged, F.coalesce("_b", F.lit(False)).alias("bridge"), nothing("_p").alias("connectivity"), nothing("_s").alias("share"), nothing("_m").alias("moment"))
    # equal up to rounding is equal, as for parts that are sums in another order
    order = out.select("*", F.round(-F.abs("connectivity"), 9).alias("_1"), F.round(-F.abs("moment"), 6).alias("_2"), F.round(-F.col("merged"), 9).alias("_3"))
    ranked = numbered(order, "_1", "_2", "_3", "_key", name="_n")
    return ranked.select(*links.columns, "merged", "bridge", "connectivity", "share", "moment", (F.col("_n") + 1).alias("rank"))
