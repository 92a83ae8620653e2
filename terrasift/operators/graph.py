"""Fault graphs on masks: degrees, ends, lengths, strikes, closures, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .components import components, label8
from .neighbours import offsets, spread

AROUND = offsets(2, 1)


def degrees(mask: DataFrame) -> DataFrame:
    """Adds ``degree``, the number of 8-neighbours, to each cell."""
    cells = mask.select("r", "c").distinct()
    count = spread(cells, AROUND).groupBy("r", "c").agg(F.count(F.lit(1)).alias("degree"))
    return cells.join(count, ["r", "c"], "left").select("r", "c", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def endpoints(mask: DataFrame) -> DataFrame:
    return degrees(mask).where("degree = 1").select("r", "c")


def lengths(labelled: DataFrame) -> DataFrame:
    """(comp, length): steps of 1 and sqrt 2 between neighbours, an isolated cell counts 1."""
    half = [o for o in AROUND if (o[0], o[1]) > (0, 0)]
    steps = spread(labelled.select("r", "c", "comp"), half).join(labelled.select("r", "c"), ["r", "c"]).groupBy("comp").agg(F.sum(F.sqrt("d2")).alias("length"))
    return labelled.select("comp").distinct().join(steps, "comp", "left").select("comp", F.coalesce("length", F.lit(1.0)).alias("length"))


def system_table(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.avg("r").alias("r_mean"), F.avg("c").alias("c_mean"))


def principal_strike(labelled: DataFrame, least: int = 3) -> DataFrame:
    """(comp, size, angle) of the principal axis of each component, degrees from the row axis in (-90, 90]."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    got = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.covar_pop(r, c).alias("rc"), F.var_pop(r).alias("rr"), F.var_pop(c).alias("cc")).where(F.col("size") >= least)
    return got.select("comp", "size", F.degrees(0.5 * F.atan2(2 * F.col("rc"), F.col("rr") - F.col("cc"))).alias("angle"))


def least_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, gap) of the least spanning forest, ties by (gap, lesser end, greater end).

    Boruvka's rounds: every system takes its least link to another system, and systems so joined become one. The
    number of systems with links halves at least, so rounds are few, and no task sees a whole component.
    """
    k = F.struct(F.col("gap").cast("double").alias("gap"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    todo, chosen = stored(links.where("a <> b").select(k.alias("k"), F.col("a").alias("x"), F.col("b").alias("y")).distinct()), None
    while todo.head(1):
        ends = todo.select(F.explode(F.array("x", "y")).alias("n"), "k", "x", "y")
        best = stored(ends.groupBy("n").agg(F.min(F.struct("k", "x", "y")).alias("m")).select("m.*").distinct())
        chosen = best.select("k") if chosen is None else chosen.unionByName(best.select("k"))
        roots = stored(components(best.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        moved = todo.join(to("x"), "x").join(to("y"), "y").where("x_root <> y_root").select("k", F.col("x_root").alias("x"), F.col("y_root").alias("y"))
        # of parallel links between two systems only the least can matter
        least = moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("k").alias("k"))
        last, todo = todo, stored(least.select("k", "x", "y"))
        forget(last, roots)
    return links.select("a", "b", F.col("gap").cast("double").alias("gap")).limit(0) if chosen is None else chosen.select("k.a", "k.b", "k.gap")


def closure(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Systems before and after links (a, b, gap): counts, and the gaps that merge two systems (a least forest)."""
    joined = components(links.select("a", "b"))
    after = nodes.join(joined, nodes["comp"] == joined["node"], "left").select(F.coalesce("root", "comp").alias("s")).distinct()
    forest = least_forest(links).agg(F.count(F.lit(1)).alias("merged"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap"))
    counts = nodes.agg(F.count_distinct("comp").alias("before")).join(after.agg(F.count(F.lit(1)).alias("after")), F.lit(True))
    return counts.join(forest, F.lit(True)).select("before", "after", "merged", "gap")


def flat(width: int, r: str = "r", c: str = "c") -> Column:
    return F.col(r).cast("long") * width + F.col(c)


def graph_nodes(skeleton: DataFrame, width: int) -> DataFrame:
    """(node, kind, r, c, degree, comp): clusters of junction cells (3 or more neighbours) at their rounded centre, and ends.

    Ends are cells with at most one neighbour. A node is named by its least flat id; a junction's degree adds up its cells'.
    """
    cells = stored(degrees(skeleton).join(label8(skeleton, width), ["r", "c"]))
    junction = cells.where("degree >= 3")
    marked = junction.join(label8(junction, width).withColumnRenamed("comp", "node"), ["r", "c"])
    centre = lambda x: F.bround(F.avg(x), 0).cast("int")
    clusters = marked.groupBy("node").agg(centre("r").alias("r"), centre("c").alias("c"), F.sum("degree").alias("degree"), F.min("comp").alias("comp"))
    ends = cells.where("degree <= 1").select(flat(width).alias("node"), F.lit("end").alias("kind"), "r", "c", "degree", "comp")
    return clusters.select("node", F.lit("junction").alias("kind"), "r", "c", "degree", "comp").unionByName(ends)


def graph_edges(skeleton: DataFrame, width: int) -> DataFrame:
    """(edge, u, v, cells, comp): one edge per chain of cells that are no junction, named by its least flat id.

    Its nodes are, from each end of the chain (ends in raster order), the junctions that the end touches, in raster
    order of the touched cells, and the end itself where it is a free tip; the first two of these. With one, both
    are that; a ring without junctions has null.
    """
    cells = stored(degrees(skeleton))
    junction = cells.where("degree >= 3")
    cluster = stored(label8(junction, width).withColumnRenamed("comp", "node"))
    chain = cells.where("degree < 3")
    marked = stored(chain.join(label8(chain, width).withColumnRenamed("comp", "edge"), ["r", "c"]))
    inner = degrees(chain).withColumnRenamed("degree", "inner")
    tips = marked.join(inner, ["r", "c"]).where("inner <= 1").select("edge", "r", "c", "degree")
    touched = spread(tips.select("r", "c", "edge", F.col("r").alias("r0"), F.col("c").alias("c0")), AROUND).join(cluster, ["r", "c"])
    hits = touched.select("edge", F.struct(F.col("r0").alias("r0"), F.col("c0").alias("c0"), F.lit(0).alias("own"), "r", "c", "node").alias("t"))
    free = tips.where("degree <= 1").select("edge", F.struct(F.col("r").alias("r0"), F.col("c").alias("c0"), F.lit(1).alias("own"), "r", "c", flat(width).alias("node")).alias("t"))
    found = hits.unionByName(free).groupBy("edge").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["node"])).alias("nodes"))
    size = marked.join(label8(skeleton, width), ["r", "c"]).groupBy("edge").agg(F.count(F.lit(1)).alias("cells"), F.min("comp").alias("comp"))
    first, second = F.get("nodes", F.lit(0)), F.get("nodes", F.lit(1))
    return size.join(found, "edge", "left").select("edge", first.alias("u"), F.coalesce(second, first).alias("v"), "cells", "comp")


def graph_summary(skeleton: DataFrame, nodes: DataFrame, edges: DataFrame, height: int, width: int) -> DataFrame:
    """One row of counts: cells, systems, ends, junctions, edges, independent loops, and enclosed background regions.

    Loops are edges less nodes plus parts of the graph, with edges that have nodes. A background region (4
    neighbours) is enclosed unless it reaches the edge of the grid; ``enclosed_20`` counts those of 20 cells or more.
    """
    known = edges.where("u is not null")
    parts = components(known.select(F.col("u").alias("a"), F.col("v").alias("b"))).select("root").distinct().agg(F.count(F.lit(1)).alias("linked"))
    ends = known.select(F.explode(F.array("u", "v")).alias("n"), (F.col("u") == F.col("v")).alias("loop"))
    # a node none of whose edges leads to another one is a part by itself
    alone = nodes.join(ends.where("not loop").select(F.col("n").alias("node")).distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("alone"))
    grid = skeleton.sparkSession.range(height * width).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    empty = label8(grid.join(skeleton.select("r", "c"), ["r", "c"], "left_anti"), width, 1)
    region = empty.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max(((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == height - 1) | (F.col("c") == width - 1)).cast("int")).alias("open")).where("open = 0")
    rows = [
        skeleton.agg(F.count(F.lit(1)).alias("skeleton_cells")),
        nodes.agg(F.count_if(F.col("kind") == "end").alias("ends"), F.count_if(F.col("kind") == "junction").alias("junctions"), F.count_distinct("comp").alias("systems")),
        known.agg(F.count(F.lit(1)).alias("edges"), F.count_if((F.col("u") == F.col("v")) & (F.col("cells") <= 3)).alias("small_loops")),
        parts, alone, region.agg(F.count(F.lit(1)).alias("enclosed"), F.count_if(F.col("n") >= 20).alias("enclosed_20")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row), F.lit(True))
    return out.withColumn("loops", F.col("edges") - F.col("ends") - F.col("junctions") + F.col("linked") + F.col("alone")).drop("linked", "alone")


def end_tangents(skeleton: DataFrame, width: int, steps: int = 8, least: int = 3) -> DataFrame:
    """(r, c, layers, ty, tx): unit vector out of each end, from the mean of the cells reached in the last of ``steps`` steps.

    Steps spread over the skeleton from each end at once; null with fewer than ``least`` layers (the end's own counts).
    """
    cells = stored(skeleton.select("r", "c").distinct())
    ends = endpoints(cells).select("r", "c", F.col("r").alias("r0"), F.col("c").alias("c0"))
    seen = front = stored(ends.withColumn("layer", F.lit(1)))
    for layer in range(2, steps + 2):
        reach = spread(front.select("r", "c", "r0", "c0"), AROUND).select("r", "c", "r0", "c0").distinct().join(cells, ["r", "c"])
        front = stored(reach.join(seen, ["r", "c", "r0", "c0"], "left_anti").withColumn("layer", F.lit(layer)))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    layers = seen.groupBy("r0", "c0", "layer").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"))
    far = layers.groupBy("r0", "c0").agg(F.max("layer").alias("layers"), F.max_by(F.struct("mr", "mc"), "layer").alias("m"))
    dy, dx = F.col("r0") - F.col("m.mr"), F.col("c0") - F.col("m.mc")
    size = F.sqrt(dy * dy + dx * dx)
    fine = (F.col("layers") >= least) & (size > 0)
    return far.select(F.col("r0").alias("r"), F.col("c0").alias("c"), "layers", F.when(fine, dy / size).alias("ty"), F.when(fine, dx / size).alias("tx"))


def density_clusters(points: DataFrame, eps2: int, least: int) -> DataFrame:
    """DBSCAN on grid points: (r, c, cluster); cores have ``least`` points within the radius, themselves counted.

    Clusters are components of cores; a border point goes to the lowest cluster id; noise is null.
    """
    cells = points.select("r", "c").distinct()
    reach = spread(cells.withColumn("r0", F.col("r")).withColumn("c0", F.col("c")), offsets(eps2))
    pairs = reach.join(cells, ["r", "c"]).select("r0", "c0", "r", "c")
    cores = pairs.groupBy(F.col("r0").alias("r"), F.col("c0").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("r", "c")
    named = label8(cores, 1_000_000, eps2).select(F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("comp").alias("cluster"))
    best = pairs.join(named, ["r0", "c0"]).groupBy("r", "c").agg(F.min("cluster").alias("low"))
    inside = named.select(F.col("r0").alias("r"), F.col("c0").alias("c"), "cluster")
    return cells.join(best, ["r", "c"], "left").join(inside, ["r", "c"], "left").select("r", "c", F.coalesce("cluster", "low").alias("cluster"))
