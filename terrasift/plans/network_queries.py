"""Graphs on skeletons, links between them, and chosen dots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import graph, links, metric, neighbours as nb, selection, surfaces
from ..operators.components import label8
from ..sources.cells import cells, mask
from ..storage import stored
from .cell_queries import six
from .place_queries import SPARSE, registry, sparse
from .registry import query

_DEGREE = "deg AS (SELECT m.r, m.c, m.id, count(o.id) degree FROM m LEFT JOIN m o ON abs(o.r - m.r) <= 1 AND abs(o.c - m.c) <= 1 AND o.id <> m.id GROUP BY 1, 2, 3)"
_PART = """{n} AS (SELECT r, c, id, degree FROM deg WHERE {test}), {n}_e AS (SELECT a.id a, b.id b FROM {n} a JOIN {n} b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
 {n}_reach AS (SELECT id, id root FROM {n} UNION SELECT e.b, x.root FROM {n}_reach x JOIN {n}_e e ON e.a = x.id), {n}_comp AS (SELECT {n}.*, min(root) part FROM {n}_reach JOIN {n} USING (id) GROUP BY ALL)"""
_JUNCTION, _CHAIN = _PART.format(n="jun", test="degree >= 3"), _PART.format(n="cha", test="degree < 3")
_NODES = f"""nodes AS (SELECT part node, 'junction' kind, CAST(round_even(avg(j.r), 0) AS INTEGER) r, CAST(round_even(avg(j.c), 0) AS INTEGER) c, CAST(sum(degree) AS BIGINT) degree, min(comp) comp FROM jun_comp j JOIN comp USING (id) GROUP BY 1
 UNION ALL SELECT id, 'end', deg.r, deg.c, degree, comp FROM deg JOIN comp USING (id) WHERE degree <= 1)"""
_EDGES = """tip AS (SELECT a.part edge, a.r, a.c, a.degree FROM cha_comp a LEFT JOIN cha b ON abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND b.id <> a.id GROUP BY ALL HAVING count(b.id) <= 1),
 hit AS (SELECT edge, tip.r r0, tip.c c0, 0 own, j.r, j.c, part node FROM tip JOIN jun_comp j ON abs(j.r - tip.r) <= 1 AND abs(j.c - tip.c) <= 1 UNION ALL SELECT edge, r, c, 1, r, c, CAST(r * 256 + c AS BIGINT) FROM tip WHERE degree <= 1),
 first AS (SELECT edge, node, min((r0, c0, own, r, c)) k FROM hit GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY k) p FROM first),
 edges AS (SELECT part edge, min(u.node) u, coalesce(min(v.node), min(u.node)) v, count(DISTINCT x.id) AS "cells", min(comp) comp FROM cha_comp x JOIN comp USING (id) LEFT JOIN rk u ON u.edge = part AND u.p = 1 LEFT JOIN rk v ON v.edge = part AND v.p = 2 GROUP BY 1)"""


@query("q_graph_nodes", f"WITH RECURSIVE {SPARSE}, {_DEGREE}, {_JUNCTION}, {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_nodes(sparse(spark, d), 256)


@query("q_graph_edges", f"WITH RECURSIVE {SPARSE}, {_DEGREE}, {_JUNCTION}, {_CHAIN}, {_EDGES} SELECT * REPLACE (coalesce(u, -1) AS u, coalesce(v, -1) AS v) FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with their nodes, -1 where a ring has none."""
    return graph.graph_edges(sparse(spark, d), 256).na.fill(-1, ["u", "v"])


@query("q_graph_summary")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    x = stored(sparse(spark, d))
    return graph.graph_summary(x, graph.graph_nodes(x, 256), graph.graph_edges(x, 256), 256, 256)


@query("q_end_tangents")
def end_tangents(spark: SparkSession, d: str) -> DataFrame:
    return graph.end_tangents(sparse(spark, d), 256).select("r", "c", "layers", *six("ty", "tx"))


@query("q_least_forest")
def least_forest(spark: SparkSession, d: str) -> DataFrame:
    return graph.least_forest(cone(spark, d).select(F.col("comp_src").alias("a"), F.col("comp_tgt").alias("b"), F.sqrt("d2").alias("gap"))).select("a", "b", *six("gap"))


def cone(spark: SparkSession, d: str) -> DataFrame:
    """Links of ends, heading away from their component, to the nearest other component in a cone."""
    x = stored(label8(sparse(spark, d), 256))
    ends = links.outward(x, graph.endpoints(x).join(x, ["r", "c"]), 5).select("r", "c", "comp", F.col("dy").alias("ty"), F.col("dx").alias("tx"))
    return stored(links.cone_links(ends, x, 20, 9, math.cos(math.radians(30))))


@query("q_marker_offsets", f"""WITH RECURSIVE {SPARSE}, {_DEGREE}, ends AS (SELECT deg.r, deg.c, comp, CAST(deg.id % 180 AS DOUBLE) strike FROM deg JOIN comp USING (id) WHERE degree = 1),
 head AS (SELECT e.r, e.c, e.comp, e.strike, e.r - avg(p.r) y, e.c - avg(p.c) x FROM ends e JOIN comp p ON p.comp = e.comp AND abs(p.r - e.r) <= 5 AND abs(p.c - e.c) <= 5 GROUP BY e.r, e.c, e.comp, e.strike),
 h AS (SELECT r, c, comp, strike, y / sqrt(y * y + x * x) dy, x / sqrt(y * y + x * x) dx FROM head),
 p AS (SELECT a.r r0, a.c c0, b.r r1, b.c c1, a.dy ady, a.dx adx, b.dy bdy, b.dx bdx, CAST(b.r - a.r AS DOUBLE) y, CAST(b.c - a.c AS DOUBLE) x, radians((a.strike + b.strike) / 2) t, abs(a.strike - b.strike) % 180 u FROM h a JOIN h b ON (a.r, a.c) < (b.r, b.c) AND a.comp <> b.comp AND abs(a.r - b.r) <= 24 AND abs(a.c - b.c) <= 24),
 g AS (SELECT *, abs(y * sin(t) + x * cos(t)) gap, abs(x * sin(t) - y * cos(t)) shift, least(u, 180 - u) turn, sqrt(y * y + x * x) n FROM p),
 k AS (SELECT * FROM g WHERE turn <= 90 AND gap BETWEEN 1 AND 14 AND shift BETWEEN 0.5 AND 10 AND n <= 24 AND ady * y + adx * x >= cos(radians(89)) * n AND bdy * y + bdx * x <= -cos(radians(89)) * n),
 l AS (SELECT r0, c0, r1, c1, gap, shift, turn, greatest(round_even(n, 0), 1) m, unnest(range(0, CAST(greatest(round_even(n, 0), 1) AS BIGINT) + 1)) i FROM k),
 q AS (SELECT l.*, CASE WHEN CAST(round_even(r0 + (r1 - r0) * i / m, 0) + round_even(c0 + (c1 - c0) * i / m, 0) AS BIGINT) % 17 <> 0 THEN 1 END hit FROM l)
 SELECT r0, c0, r1, c1, round(any_value(gap), 6) AS gap, round(any_value(shift), 6) AS shift, any_value(turn) AS turn FROM q GROUP BY 1, 2, 3, 4 HAVING count(*) = count(hit)""")
def marker_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ends like one displaced line; every 17th diagonal of the grid is not valid."""
    x = stored(label8(sparse(spark, d), 256))
    ends = links.outward(x, graph.endpoints(x).join(x, ["r", "c"]), 5).withColumn("strike", ((F.col("r") * 256 + F.col("c")) % 180).cast("double"))
    grid = spark.range(256 * 256).select(F.floor(F.col("id") / 256).cast("int").alias("r"), (F.col("id") % 256).cast("int").alias("c"))
    got = links.marker_offsets(ends, grid.where("(r + c) % 17 <> 0"), (1, 14), (0.5, 10), 90.0, math.cos(math.radians(89)))
    return got.select("r0", "c0", "r1", "c1", F.round("gap", 6).alias("gap"), F.round("offset", 6).alias("shift"), "turn")


@query("q_candidate_set")
def candidate_set(spark: SparkSession, d: str) -> DataFrame:
    """Candidate links with their evidence, one of each mutual pair, the dots they add, and what these share with the base."""
    found = cone(spark, d).withColumn("length", F.sqrt("d2"))
    tests = s.score_of(F.col("length") <= 10, F.col("comp_src") % 2 == 0, F.col("comp_tgt") % 3 == 0)
    chosen = stored(links.mutual_pairs(found.withColumn("z", tests).where("z >= 1").select("r", "c", "q_r", "q_c"), 2))
    return links.link_dots(chosen, mask(cells(spark, d), "flag = 'A'"), stored(label8(sparse(spark, d), 256)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the sparse pool with a weight."""
    return cells(spark, d).where("q >= 49").select("r", "c", (F.col("v") / 100_000).alias("w"))


@query("q_spaced_blocked")
def spaced_blocked(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    return selection.spaced(x.where("q >= 45").select("r", "c", "v"), "v", 8, mask(x, "q < 5"), 500)


@query("q_random_spaced")
def random_spaced(spark: SparkSession, d: str) -> DataFrame:
    return selection.random_spaced(scored(spark, d), 8, 3, 300)


@query("q_kernel_cover")
def kernel_cover(spark: SparkSession, d: str) -> DataFrame:
    pool = scored(spark, d).select("r", "c", F.lit(1.0).alias("w"))
    return selection.cover_greedily(pool.where("(r + c) % 2 = 0"), 60, 8, pool).select("r", "c", *six("gain"))


@query("q_cover_thin")
def cover_thin(spark: SparkSession, d: str) -> DataFrame:
    return selection.cover_thin(sparse(spark, d), 60, 0.4)


@query("q_ridge_base")
def ridge_base(spark: SparkSession, d: str) -> DataFrame:
    fold = (F.floor(F.col("r") / 128) * 2 + F.floor(F.col("c") / 128)).alias("fold")
    return selection.ridge_base(cells(spark, d).select("r", "c", "v", fold), "v", 0.02, 3, "fold")


@query("q_corridor")
def corridor(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    return selection.allocate_corridor(x.select("r", "c", (F.col("v") / 100_000).alias("p")), "p", mask(x, "q >= 50"), 0.001, 0.98, 4).select("r", "c", *six("gain"))


@query("q_packing_arms")
def packing_arms(spark: SparkSession, d: str) -> DataFrame:
    return selection.packing_arms(sparse(spark, d).withColumn("v", (F.col("r") * 7 + F.col("c") * 13) % 101), "v", 40, 8, 5)


@query("q_quota_fill")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    parent = mask(x, "q >= 49").withColumn("far", (F.col("r") * 31 + F.col("c") * 17) % 97)
    return selection.quota_fill(parent, "far", mask(x, "q BETWEEN 20 AND 24"), registry(spark, d), 0.5, 0.7, 8, 11)



@query("q_final_dots")
def final_dots(spark: SparkSession, d: str) -> DataFrame:
    """Ridge cells of a surface that are eligible, the 100 highest."""
    x = cells(spark, d)
    ridge = surfaces.ridges(surfaces.gradient(x.select("r", "c", "v"), "v"), "v")
    eligible = nb.near_distance(ridge, mask(x, "q >= 50"), 2).where("d2 is null")
    return selection.top_k(eligible, "v", 100).select("r", "c", "v")


@query("q_losfo_split", f"""WITH RECURSIVE {SPARSE}, t AS (SELECT comp, avg(r) cy, avg(c) cx, (CASE WHEN round_even(avg(r), 0) < 128 THEN 0 ELSE 2 END) + (CASE WHEN round_even(avg(c), 0) < 128 THEN 0 ELSE 1 END) fold FROM comp GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('7|' || comp), comp) i, count(*) OVER (PARTITION BY fold) n FROM t), held AS (SELECT comp, fold FROM k WHERE i <= greatest(round_even(n * 0.25, 0), 1)),
 hidden AS (SELECT r, c, fold FROM comp JOIN held USING (comp)), known AS (SELECT r, c FROM comp a WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE abs(h.r - a.r) <= 6 AND abs(h.c - a.c) <= 6)),
 sep AS (SELECT fold, min((h.r - k.r) * (h.r - k.r) + (h.c - k.c) * (h.c - k.c)) d2 FROM hidden h, known k GROUP BY 1)
 SELECT fold, count(*) AS hidden, (SELECT count(*) FROM known) AS known, CAST(any_value(d2) AS BIGINT) AS separation2 FROM hidden JOIN sep USING (fold) GROUP BY 1""")
def losfo_split(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import splits

    return splits.losfo(label8(sparse(spark, d), 256), 128, 128, 0.25, 7, 6, 256)


@query("q_budget_sweep")
def budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Dots, blind credit, crowding and modelled score of a mask thinned to several spacings."""
    x = cells(spark, d)
    return metric.budget_sweep(mask(x, "q >= 50"), x.select("r", "c"), [1, 3, 5, 9], 300.0, 120.0)
