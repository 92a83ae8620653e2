"""Joins by place, filters over neighbourhoods, links, graphs, selection, folds and gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import graph, links, metric, models, neighbours as nb, segments, selection, splits, statistics as st, surfaces, textures, walks
from ..operators.components import label8
from ..sources.cells import cells, mask, sites, table, vertices
from ..sources.files import content_digest
from ..storage import stored
from .cell_queries import VERTEX, six
from .registry import CELL, MASKS, digest, offs, query

#: A sparse mask and its 8-connected components, in SQL.
SPARSE = f"""{CELL}, m AS (SELECT r, c, CAST(r * 256 + c AS BIGINT) id FROM cell WHERE q >= 50), e AS (SELECT a.id a, b.id b FROM m a JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
 reach AS (SELECT id, id root FROM m UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), comp AS (SELECT m.r, m.c, m.id, min(root) comp FROM reach JOIN m USING (id) GROUP BY 1, 2, 3)"""


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return mask(cells(spark, d), "q >= 50")


def supplier_sites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 256).cast("int").alias("r"), (k * 91 % 256).cast("int").alias("c"), F.col("s_acctbal").alias("w"), (k * 17 % 180).cast("double").alias("strike"))


SITE = "site AS (SELECT s_suppkey id, CAST(s_suppkey * 37 % 256 AS INTEGER) r, CAST(s_suppkey * 91 % 256 AS INTEGER) c, s_acctbal w, CAST(s_suppkey * 17 % 180 AS DOUBLE) strike FROM supplier)"


@query("q_edt", f"WITH {CELL}, {SITE} SELECT cell.r, cell.c, CAST(min((cell.r - site.r) * (cell.r - site.r) + (cell.c - site.c) * (cell.c - site.c)) AS BIGINT) AS d2 FROM cell, site GROUP BY 1, 2")
def edt(spark: SparkSession, d: str) -> DataFrame:
    got = nb.nearest(cells(spark, d).select("r", "c"), supplier_sites(spark, d).select("r", "c"), 256)
    return got.select("r", "c", "d2")


@query("q_fill_nearest", f"""WITH {CELL}, good AS (SELECT r, c, v FROM cell WHERE q >= 10), bad AS (SELECT r, c FROM cell WHERE q < 10), k AS (SELECT bad.r, bad.c, v, row_number() OVER (PARTITION BY bad.r, bad.c ORDER BY (bad.r - good.r) * (bad.r - good.r) + (bad.c - good.c) * (bad.c - good.c), good.r, good.c) p
 FROM bad JOIN good ON abs(bad.r - good.r) <= 12 AND abs(bad.c - good.c) <= 12) SELECT r, c, v AS filled FROM k WHERE p = 1""")
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    got = surfaces.fill_nearest(x, "v", F.col("q") >= 10, 256)
    return got.join(mask(x, "q < 10"), ["r", "c"], "left_semi").select("r", "c", "filled")


@query("q_overlap", f"WITH {MASKS}, {offs(9)}, m AS (SELECT DISTINCT r + dy r, c + dx c, 1 hit FROM cell, offs WHERE q >= 49) SELECT count(*) AS dots, count(hit) AS inside, round(avg(coalesce(hit, 0)), 9) AS share FROM pred LEFT JOIN m USING (r, c)")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    return metric.overlap(mask(x, "flag = 'A'"), mask(x, "q >= 49")).select("dots", "inside", F.round("share", 9).alias("share"))


REGISTRY = "reg AS (SELECT DISTINCT l_suppkey % 9 f, CAST(l_partkey % 256 AS INTEGER) r, CAST(l_orderkey % 256 AS INTEGER) c FROM lineitem WHERE l_quantity >= 48)"


def registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity >= 48").select((F.col("l_suppkey") % 9).alias("f"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_orderkey") % 256).cast("int").alias("c")).distinct()


@query("q_overlap_matrix", f"WITH {REGISTRY}, {offs(9)}, s AS (SELECT DISTINCT f, r + dy r, c + dx c FROM reg, offs), n AS (SELECT f, count(*) n FROM reg GROUP BY 1), k AS (SELECT a.f fa, s.f fb, count(*) k FROM reg a JOIN s ON a.r = s.r AND a.c = s.c AND a.f <> s.f GROUP BY 1, 2) SELECT a.f AS file_a, b.f AS file_b, coalesce(k, 0) AS inside, round(coalesce(k, 0) / a.n::DOUBLE, 9) AS share FROM n a JOIN n b ON a.f <> b.f LEFT JOIN k ON fa = a.f AND fb = b.f")
def overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Share of each file's dots near each other file's, 0 where none is: one spread, one join, and the table of all pairs of files."""
    reg = registry(spark, d)
    near = nb.spread(reg.withColumnRenamed("f", "g"), nb.WITHIN3).select("g", "r", "c").distinct()
    n = reg.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    shared = reg.join(near, ["r", "c"]).where("f <> g").groupBy("f", "g").agg(F.count(F.lit(1)).alias("inside"))
    every = n.join(F.broadcast(n.select(F.col("f").alias("g"))), F.col("f") != F.col("g"))
    both = every.join(shared, ["f", "g"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)).cast("long"))
    return both.select(F.col("f").alias("file_a"), F.col("g").alias("file_b"), "inside", F.round(F.col("inside") / F.col("n"), 9).alias("share"))


@query("q_duplicate_files", f"WITH {REGISTRY}, flat AS (SELECT f, CAST(r * 256 + c AS BIGINT) k FROM (SELECT * FROM reg UNION ALL SELECT f + 9, r, c FROM reg WHERE f < 3)), {digest('flat', 'f')} SELECT digest, count(*) AS files, min(f) AS first_file FROM tree4 GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    """Equal dot sets by digest; three files are registered twice under another name."""
    reg = registry(spark, d)
    all_ = reg.unionByName(reg.where("f < 3").withColumn("f", F.col("f") + 9)).select("f", (F.col("r").cast("long") * 256 + F.col("c")).alias("k"))
    return content_digest(all_, "k", "f").groupBy("digest").agg(F.count(F.lit(1)).alias("files"), F.min("f").alias("first_file")).where("files > 1")


@query("q_line_distance", f"""WITH {VERTEX}, {CELL}, seg AS (SELECT * FROM (SELECT line, seq, r a_r, c a_c, lead(r) OVER w q_r, lead(c) OVER w q_c FROM vertex WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE q_r IS NOT NULL),
 g AS (SELECT r, c, line, seq, r - a_r y, c - a_c x, CAST(q_r - a_r AS DOUBLE) dy, CAST(q_c - a_c AS DOUBLE) dx FROM cell, seg), t AS (SELECT *, CASE WHEN dy = 0 AND dx = 0 THEN 0.0 ELSE least(greatest((y * dy + x * dx) / (dy * dy + dx * dx), 0.0), 1.0) END t FROM g),
 k AS (SELECT r, c, min((round((y - t * dy) * (y - t * dy) + (x - t * dx) * (x - t * dx), 9), line, seq)) k FROM t GROUP BY 1, 2) SELECT r, c, k[2] AS line, CAST(k[3] AS BIGINT) AS seq, round(k[1], 6) AS d2 FROM k""")
def line_distance(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with the nearest segment of all lines, at any distance."""
    return segments.nearest_line(cells(spark, d), segments.segments_of(vertices(spark, d)), 512.0, 0.5).select("r", "c", "line", F.col("seq").cast("long").alias("seq"), F.round("d2", 6).alias("d2"))


@query("q_nearest_polyline", f"WITH {CELL}, {offs(25)}, {VERTEX}, k AS (SELECT r + dy r, c + dx c, min(d2 * 10000000 + line) k FROM vertex, offs GROUP BY 1, 2) SELECT r, c, k % 10000000 AS line, k // 10000000 AS d2 FROM cell JOIN k USING (r, c)")
def nearest_polyline(spark: SparkSession, d: str) -> DataFrame:
    """The nearest polyline within 5 cells, ties by its id."""
    v = vertices(spark, d).groupBy("r", "c").agg(F.min("line").alias("line"))  # of lines through one place the least is the nearest
    near = nb.spread(v, nb.offsets(25)).groupBy("r", "c").agg(F.min(F.struct("d2", "line")).alias("k"))
    return cells(spark, d).join(near, ["r", "c"]).select("r", "c", "k.line", F.col("k.d2").cast("long").alias("d2"))


@query("q_annotate_links", f"WITH {VERTEX}, seg AS (SELECT line, seq, r, c, lead(r) OVER w q_r, lead(c) OVER w q_c FROM vertex WINDOW w AS (PARTITION BY line ORDER BY seq)), {CELL} SELECT line, seq, a.flag AS flag_src, b.flag AS flag_tgt, coalesce(a.flag = b.flag, false) AS same FROM seg LEFT JOIN cell a ON a.r = seg.r AND a.c = seg.c LEFT JOIN cell b ON b.r = q_r AND b.c = q_c WHERE q_r IS NOT NULL")
def annotate_links(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("seq")
    seg = vertices(spark, d).withColumn("q_r", F.lead("r").over(w)).withColumn("q_c", F.lead("c").over(w)).where("q_r IS NOT NULL")
    x = cells(spark, d)
    a = x.select("r", "c", F.col("flag").alias("flag_src"))
    b = x.select(F.col("r").alias("q_r"), F.col("c").alias("q_c"), F.col("flag").alias("flag_tgt"))
    out = seg.join(a, ["r", "c"], "left").join(b, ["q_r", "q_c"], "left")
    return out.select("line", F.col("seq").cast("long").alias("seq"), "flag_src", "flag_tgt", F.coalesce(F.col("flag_src") == F.col("flag_tgt"), F.lit(False)).alias("same"))


@query("q_cone_links", f"""WITH RECURSIVE {SPARSE}, src AS (SELECT *, (id % 4) h FROM comp), p AS (SELECT s.r, s.c, s.comp comp_src, t.r q_r, t.c q_c, t.comp comp_tgt, CAST((t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c) AS BIGINT) d2,
 (t.r - s.r) * CASE h WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 0 END + (t.c - s.c) * CASE h WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END dot FROM src s JOIN comp t ON t.comp <> s.comp AND abs(t.r - s.r) <= 20 AND abs(t.c - s.c) <= 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, q_r, q_c) n FROM p WHERE d2 > 0 AND d2 <= 400 AND dot >= cos(radians(30)) * sqrt(d2) - 1e-9) SELECT r, c, comp_src, q_r, q_c, comp_tgt, d2 FROM k WHERE n = 1 AND d2 >= 9""")
def cone_links(spark: SparkSession, d: str) -> DataFrame:
    x = label8(sparse(spark, d), 256)
    h = (F.col("r") * 256 + F.col("c")) % 4
    ends = x.withColumn("ty", F.when(h == 0, 1).when(h == 2, -1).otherwise(0)).withColumn("tx", F.when(h == 1, 1).when(h == 3, -1).otherwise(0))
    return links.cone_links(ends, x, 20, 9, math.cos(math.radians(30)))


@query("q_strike_compat", f"""WITH {SITE}, pt AS (SELECT id, r, c, (id * 7 % 180) st FROM (SELECT c_custkey id, CAST(c_custkey * 7 % 256 AS INTEGER) r, CAST(c_custkey * 13 % 256 AS INTEGER) c FROM customer)),
 p AS (SELECT pt.id, exp(-sqrt((pt.r - s.r) * (pt.r - s.r) + (pt.c - s.c) * (pt.c - s.c)) / 20.0) w, least(abs(pt.st - s.strike), 180 - abs(pt.st - s.strike)) <= 20 ok FROM pt, site s WHERE (pt.r - s.r) * (pt.r - s.r) + (pt.c - s.c) * (pt.c - s.c) <= 1600)
 SELECT id, round(sum(CASE WHEN ok THEN w ELSE 0 END) / greatest(sum(w), 1e-12), 6) AS share, count(*) AS n FROM p GROUP BY 1""")
def strike_compat(spark: SparkSession, d: str) -> DataFrame:
    pts = sites(spark, d).select("id", "r", "c", (F.col("id") * 7 % 180).cast("double").alias("st"))
    got = links.weighted_share(pts, supplier_sites(spark, d).select("id", "r", "c", "strike"), 40, s.half_turn(F.col("a_st"), F.col("b_strike")) <= 20, 20.0)
    return got.select(F.col("a_id").alias("id"), *six("share"), "n")


@query("q_borrow", f"""WITH {SITE}, p AS (SELECT c.c_custkey id, s.id sid, s.w, CAST((CAST(c.c_custkey * 7 % 256 AS INTEGER) - s.r) * (CAST(c.c_custkey * 7 % 256 AS INTEGER) - s.r) + (CAST(c.c_custkey * 13 % 256 AS INTEGER) - s.c) * (CAST(c.c_custkey * 13 % 256 AS INTEGER) - s.c) AS BIGINT) d2 FROM customer c, site s),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, sid) n FROM p WHERE d2 <= 900) SELECT id, round(sum(w / (sqrt(d2) + 1)) / sum(1 / (sqrt(d2) + 1)), 4) AS w, count(*) AS n FROM k WHERE n <= 3 GROUP BY 1""")
def borrow(spark: SparkSession, d: str) -> DataFrame:
    got = links.borrow(sites(spark, d).select("id", "r", "c"), supplier_sites(spark, d).select("id", "r", "c", "w"), 30, F.lit(True), "w")
    return got.select(F.col("a_id").alias("id"), F.round("w", 4).alias("w"), F.col("n").cast("long").alias("n"))


LINK = "lk AS (SELECT DISTINCT CAST(l_partkey % 40 AS INTEGER) r, CAST(l_suppkey % 40 AS INTEGER) c, CAST(l_orderkey % 40 AS INTEGER) q_r, CAST(l_linenumber * 7 % 40 AS INTEGER) q_c FROM lineitem WHERE l_quantity >= 49)"


@query("q_mutual", f"""WITH {LINK} SELECT * FROM lk a WHERE NOT EXISTS (SELECT 1 FROM lk b WHERE abs(b.q_r - a.r) <= 1 AND abs(b.q_c - a.c) <= 1 AND abs(b.r - a.q_r) <= 1 AND abs(b.c - a.q_c) <= 1 AND (b.r, b.c, b.q_r, b.q_c) < (a.r, a.c, a.q_r, a.q_c))""")
def mutual(spark: SparkSession, d: str) -> DataFrame:
    mod = lambda x: (x % 40).cast("int")
    x = table(spark, d, "lineitem").where("l_quantity >= 49").select(mod(F.col("l_partkey")).alias("r"), mod(F.col("l_suppkey")).alias("c"), mod(F.col("l_orderkey")).alias("q_r"), mod(F.col("l_linenumber") * 7).alias("q_c")).distinct()
    return links.mutual_pairs(x, 1)


@query("q_dot_strike", f"WITH {MASKS}, {offs(25)}, k AS (SELECT r + dy r, c + dx c, min((d2, r, c, q)) k FROM cell, offs WHERE q >= 49 GROUP BY 1, 2)  SELECT pred.r, pred.c, k[4] AS strike FROM pred JOIN k USING (r, c)".replace("min((d2, r, c, q)) k", "arg_min(q, d2 * 100000000 + r * 1000 + c) strike").replace("k[4] AS strike", "strike"))
def dot_strike(spark: SparkSession, d: str) -> DataFrame:
    """The value of the nearest ridge cell within 5 cells of each dot."""
    x = cells(spark, d)
    ridge = x.where("q >= 49").select("r", "c", F.col("r").alias("r0"), F.col("c").alias("c0"), "q")
    near = nb.spread(ridge, nb.offsets(25)).groupBy("r", "c").agg(F.min_by("q", F.struct("d2", "r0", "c0")).alias("strike"))
    return mask(x, "flag = 'A'").join(near, ["r", "c"]).select("r", "c", "strike")


@query("q_nn_spacing", f"WITH {CELL}, m AS (SELECT r, c FROM cell WHERE q >= 50), k AS (SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) d2 FROM m a, m b WHERE (a.r, a.c) <> (b.r, b.c) GROUP BY 1, 2) SELECT count(*) AS n, round(quantile_cont(sqrt(d2), 0.1), 6) AS p10, round(quantile_cont(sqrt(d2), 0.5), 6) AS p50, round(quantile_cont(sqrt(d2), 0.9), 6) AS p90 FROM k")
def nn_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the distance to the nearest other dot, however far."""
    m = mask(cells(spark, d), "q >= 50")
    apart = stored(nb.nearest(m, m, 256, least_d2=1).where("d2 is not null").select(F.sqrt("d2").alias("x")))
    cuts = st.quantile_cuts(apart, "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return cuts.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.max(f"p{p}"), 6).alias(f"p{p}") for p in (10, 50, 90)])


@query("q_shift", f"WITH {CELL} SELECT a.r, a.c, b.v AS shifted FROM cell a LEFT JOIN cell b ON b.r = a.r - 1 AND b.c = a.c + 2")
def shifted(spark: SparkSession, d: str) -> DataFrame:
    return nb.shift(cells(spark, d), 1, -2, "v", "shifted").select("r", "c", "shifted")


@query("q_oriented_means", f"""WITH {CELL}, o AS (SELECT r, c, sum(q) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 ns, sum(q) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 ew, sum(q) OVER (PARTITION BY r - c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 nwse, sum(q) OVER (PARTITION BY r + c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 nesw FROM cell)
 SELECT r, c, round(greatest(ns, ew, nwse, nesw), 6) AS most, round(greatest(ns, ew, nwse, nesw) - least(ns, ew, nwse, nesw), 6) AS anisotropy FROM o""")
def oriented_means(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d).select("r", "c", "q")
    for k in ("ns", "ew", "nwse", "nesw"):
        x = surfaces.oriented_mean(x, "q", 5, k, k)
    most, least = F.greatest("ns", "ew", "nwse", "nesw"), F.least("ns", "ew", "nwse", "nesw")
    return x.select("r", "c", F.round(most, 6).alias("most"), F.round(most - least, 6).alias("anisotropy"))


GAUSS = "g AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * j * j)) FROM (SELECT unnest(range(-4, 5)) j)) w FROM (SELECT CAST(unnest(range(-4, 5)) AS INTEGER) i))"


@query("q_gauss", f"WITH {CELL}, {GAUSS}, a AS (SELECT cell.r, cell.c, sum(n.q * w) p FROM cell, g JOIN cell n ON n.r = cell.r + i AND n.c = cell.c GROUP BY 1, 2) SELECT t.r, t.c, round(sum(n.p * w), 4) AS smooth FROM a t, g JOIN a n ON n.r = t.r AND n.c = t.c + i GROUP BY 1, 2")
def gauss(spark: SparkSession, d: str) -> DataFrame:
    g = surfaces.gaussian_taps(1.0)
    return surfaces.separable(cells(spark, d).select("r", "c", "q"), g, g, "q", "smooth").select("r", "c", F.round("smooth", 4).alias("smooth"))


GRADIENT = f"""{CELL}, n AS (SELECT t.r, t.c, t.q, d.q dn, u.q up, e.q ea, w.q we FROM cell t LEFT JOIN cell d ON d.r = t.r + 1 AND d.c = t.c LEFT JOIN cell u ON u.r = t.r - 1 AND u.c = t.c LEFT JOIN cell e ON e.r = t.r AND e.c = t.c + 1 LEFT JOIN cell w ON w.r = t.r AND w.c = t.c - 1),
 gr AS (SELECT r, c, q, CASE WHEN dn IS NOT NULL AND up IS NOT NULL THEN (dn - up) / 2 WHEN dn IS NOT NULL THEN dn - q WHEN up IS NOT NULL THEN q - up ELSE 0 END gy, CASE WHEN ea IS NOT NULL AND we IS NOT NULL THEN (ea - we) / 2 WHEN ea IS NOT NULL THEN ea - q WHEN we IS NOT NULL THEN q - we ELSE 0 END gx FROM n)"""


@query("q_gradient", f"WITH {GRADIENT} SELECT r, c, gy, gx, round(sqrt(gy * gy + gx * gx), 6) AS magnitude FROM gr")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.gradient(cells(spark, d).select("r", "c", "q"), "q").select("r", "c", "gy", "gx", *six("magnitude"))


@query("q_ridge_nms", f"""WITH {GRADIENT}, se AS (SELECT *, CASE WHEN a < 22.5 OR a >= 157.5 THEN 0 WHEN a < 67.5 THEN 1 WHEN a < 112.5 THEN 2 ELSE 3 END s FROM (SELECT *, (degrees(atan2(gy, gx)) + 180) % 180 a FROM gr)),
 st AS (SELECT *, CASE s WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 1 END y, CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END x FROM se)
 SELECT t.r, t.c, t.s AS sector FROM st t LEFT JOIN cell a ON a.r = t.r + y AND a.c = t.c + x LEFT JOIN cell b ON b.r = t.r - y AND b.c = t.c - x WHERE (t.q >= coalesce(a.q, -1e300) AND t.q > coalesce(b.q, -1e300)) OR (t.q > coalesce(a.q, -1e300) AND t.q >= coalesce(b.q, -1e300))""")
def ridge_nms(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.ridges(surfaces.gradient(cells(spark, d).select("r", "c", "q"), "q"), "q").select("r", "c", "sector")


@query("q_vesselness")
def vesselness(spark: SparkSession, d: str) -> DataFrame:
    """Bright ridges at three scales."""
    return textures.vesselness(cells(spark, d).select("r", "c", "q"), "q", 256, 256).select("r", "c", "scale", *six("vesselness"))


@query("q_box_sum", f"WITH {CELL}, {offs(8)} SELECT t.r, t.c, sum(n.q) AS total FROM cell t CROSS JOIN offs JOIN cell n ON n.r = t.r + dy AND n.c = t.c + dx WHERE abs(dy) <= 2 AND abs(dx) <= 2 GROUP BY 1, 2")
def box_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum over 5 x 5 squares by place, so holes do not matter."""
    x = cells(spark, d).select("r", "c", "q")
    moved = nb.convolve(x, [(y, z, 1.0) for y in range(-2, 3) for z in range(-2, 3)], "q", "total")
    return moved.select("r", "c", "total")


@query("q_upward")
def upward(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.upward_continue(cells(spark, d).select("r", "c", "q"), "q", 256, 256, 1.0, 32).select("r", "c", F.round("up", 6).alias("up"))


@query("q_components", f"WITH RECURSIVE {SPARSE} SELECT r, c, comp FROM comp")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return label8(sparse(spark, d), 256)


@query("q_degree", f"WITH RECURSIVE {SPARSE} SELECT m.r, m.c, count(*) - 1 AS degree FROM m JOIN e ON e.a = m.id GROUP BY 1, 2")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(sparse(spark, d))


@query("q_endpoints", f"WITH RECURSIVE {SPARSE} SELECT m.r, m.c FROM m JOIN e ON e.a = m.id GROUP BY 1, 2 HAVING count(*) = 2")
def endpoint_cells(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoints(sparse(spark, d))


@query("q_skeleton_length", f"WITH RECURSIVE {SPARSE}, st AS (SELECT a.comp, sum(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) len FROM comp a JOIN e ON e.a = a.id JOIN comp b ON b.id = e.b WHERE e.a < e.b GROUP BY 1) SELECT DISTINCT comp.comp, round(coalesce(len, 1.0), 6) AS length FROM comp LEFT JOIN st USING (comp)")
def skeleton_length(spark: SparkSession, d: str) -> DataFrame:
    return graph.lengths(label8(sparse(spark, d), 256)).select("comp", *six("length"))


@query("q_principal_strike", f"WITH RECURSIVE {SPARSE} SELECT comp, count(*) AS size, round(degrees(0.5 * atan2(2 * covar_pop(r, c), var_pop(r) - var_pop(c))), 4) AS angle FROM comp GROUP BY 1 HAVING count(*) >= 3 AND abs(2 * covar_pop(r, c)) + abs(var_pop(r) - var_pop(c)) > 1e-9")
def principal_strike(spark: SparkSession, d: str) -> DataFrame:
    x = label8(sparse(spark, d), 256)
    round_ones = x.groupBy("comp").agg((F.abs(2 * F.covar_pop(F.col("r").cast("double"), F.col("c").cast("double"))) + F.abs(F.var_pop("r") - F.var_pop("c"))).alias("k")).where("k > 1e-9").select("comp")
    return graph.principal_strike(x).join(round_ones, "comp", "left_semi").select("comp", "size", F.round("angle", 4).alias("angle"))


@query("q_closure", f"""WITH RECURSIVE {SPARSE}, lk AS (SELECT DISTINCT a.comp a, b.comp b FROM comp a JOIN comp b ON b.r = a.r + 2 AND b.c = a.c AND a.comp <> b.comp),
 le AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT comp, comp FROM comp), cr AS (SELECT a id, a root FROM le UNION SELECT le.b, cr.root FROM cr JOIN le ON le.a = cr.id), sys AS (SELECT id, min(root) s FROM cr GROUP BY 1)
 SELECT (SELECT count(DISTINCT comp) FROM comp) AS before, count(DISTINCT s) AS after, (SELECT count(DISTINCT comp) FROM comp) - count(DISTINCT s) AS merged, 2.0 * ((SELECT count(DISTINCT comp) FROM comp) - count(DISTINCT s)) AS gap FROM sys""")
def closure(spark: SparkSession, d: str) -> DataFrame:
    """What bridging gaps of two rows does to systems."""
    x = label8(sparse(spark, d), 256)
    other = x.select((F.col("r") - 2).alias("r"), "c", F.col("comp").alias("b"))
    link = x.join(other, ["r", "c"]).where("comp <> b").select(F.col("comp").alias("a"), "b", F.lit(2.0).alias("gap")).distinct()
    return graph.closure(x, link).select("before", "after", "merged", "gap")


@query("q_power_law", "SELECT count(*) AS n, round(1 + count(*) / sum(ln(n / 10.0)), 9) AS exponent FROM (SELECT CAST(count(*) + 10 AS DOUBLE) n FROM orders GROUP BY o_custkey)")
def power_law(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) + 10).cast("double").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(1 + F.count(F.lit(1)) / F.sum(F.ln(F.col("n") / 10)), 9).alias("exponent"))


@query("q_correlation_dimension", f"WITH {CELL}, m AS (SELECT r, c FROM cell WHERE q >= 50), p AS (SELECT (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) d2 FROM m a, m b WHERE (a.r, a.c) < (b.r, b.c)), k AS (SELECT rad, count(*) n FROM p, (SELECT unnest([4, 8, 16, 32]) rad) WHERE d2 <= rad * rad GROUP BY 1) SELECT round(regr_slope(ln(n), ln(rad)), 6) AS dimension FROM k")
def correlation_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Slope of log pair counts over log radius, the pairs counted by correlating tiles."""
    n = textures.pair_counts(mask(cells(spark, d), "q >= 50"), [4, 8, 16, 32])
    return n.where("pairs > 0").agg(F.round(F.regr_slope(F.ln("pairs"), F.ln("radius")), 6).alias("dimension"))


@query("q_single_linkage", f"""WITH RECURSIVE {CELL}, m AS (SELECT r, c, CAST(r * 256 + c AS BIGINT) id FROM cell WHERE q >= 50), e AS (SELECT rad, a.id a, b.id b FROM m a JOIN m b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3, (SELECT unnest([1, 2, 3]) rad) WHERE (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= rad * rad),
 re AS (SELECT rad, id, id root FROM m, (SELECT unnest([1, 2, 3]) rad) UNION SELECT re.rad, e.b, re.root FROM re JOIN e ON e.a = re.id AND e.rad = re.rad), k AS (SELECT rad, id, min(root) s FROM re GROUP BY 1, 2), n AS (SELECT rad, s, count(*) n FROM k GROUP BY 1, 2) SELECT CAST(rad AS INTEGER) AS radius, count(*) AS systems, max(n) AS largest FROM n GROUP BY 1""")
def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    m = mask(cells(spark, d), "q >= 50")
    out = None
    for radius in (1, 2, 3):
        n = label8(m, 256, radius * radius).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
        one = n.agg(F.lit(radius).alias("radius"), F.count(F.lit(1)).alias("systems"), F.max("n").alias("largest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q_dbscan", f"""WITH RECURSIVE {CELL}, m AS (SELECT r, c, CAST(r AS BIGINT) * 1000000 + c id FROM cell WHERE q >= 50), p AS (SELECT a.id a, b.id b FROM m a JOIN m b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9),
 core AS (SELECT a id FROM p GROUP BY 1 HAVING count(*) >= 4), ce AS (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)), re AS (SELECT id, id root FROM core UNION SELECT ce.b, re.root FROM re JOIN ce ON ce.a = re.id), k AS (SELECT id, min(root) s FROM re GROUP BY 1), bo AS (SELECT p.b id, min(k.s) s FROM p JOIN k ON k.id = p.a GROUP BY 1)
 SELECT m.r, m.c, coalesce(k.s, bo.s) AS cluster FROM m LEFT JOIN k ON k.id = m.id LEFT JOIN bo ON bo.id = m.id""")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return graph.density_clusters(mask(cells(spark, d), "q >= 50"), 9, 4)


@query("q_spaced")
def spaced(spark: SparkSession, d: str) -> DataFrame:
    return selection.spaced(cells(spark, d).where("flag = 'A'").select("r", "c", "v"), "v", 8).select("r", "c", "v")


@query("q_dot_thin")
def dot_thin(spark: SparkSession, d: str) -> DataFrame:
    return walks.thin(sparse(spark, d), 256, 3)


@query("q_coverage_greedy")
def coverage_greedy(spark: SparkSession, d: str) -> DataFrame:
    x = mask(cells(spark, d), "q >= 50").withColumn("w", F.lit(1.0))
    return selection.cover_greedily(x, 50).select("r", "c", *six("gain"))


FOLD = "fo AS (SELECT *, (CASE WHEN r < r0 THEN 0 ELSE 2 END) + (CASE WHEN c < c0 THEN 0 ELSE 1 END) fold FROM cell, (SELECT floor(quantile_cont(r, 0.5)) r0, floor(quantile_cont(c, 0.5)) c0 FROM cell))"


@query("q_folds", f"WITH {CELL}, {FOLD} SELECT CAST(fold AS INTEGER) AS fold, count(*) AS cells, count_if(flag = 'R') AS truth FROM fo GROUP BY 1", whole="truth")
def folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.quadrant_folds(cells(spark, d)).groupBy("fold").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("flag") == "R").alias("truth"))


@query("q_hidden_systems", f"WITH RECURSIVE {SPARSE}, sy AS (SELECT comp, min(r) // 128 AS half FROM comp GROUP BY 1), k AS (SELECT comp, half, row_number() OVER (PARTITION BY half ORDER BY md5('4242|' || comp), comp) k, count(*) OVER (PARTITION BY half) n FROM sy) SELECT comp, CAST(half AS BIGINT) AS half FROM k WHERE k <= greatest(round_even(n * 0.2, 0), 1)")
def hidden_systems(spark: SparkSession, d: str) -> DataFrame:
    sy = label8(sparse(spark, d), 256).groupBy("comp").agg(F.floor(F.min("r") / 128).alias("half"))
    return splits.hidden_systems(sy, 0.2, 4242, "half").select("comp", "half")


@query("q_oof_boosting")
def oof_boosting(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of out-of-fold boosted probabilities, by fold."""
    x = splits.quadrant_folds(cells(spark, d)).select("r", "c", "fold", "v", "q", F.nullif("tax", F.lit(0.08)).alias("tax"), (F.col("q") + F.col("disc") * 100 >= 50).cast("int").alias("y"))
    out = models.out_of_fold(x, ["v", "q", "tax"], "y", "fold", 4, trees=5)
    return st.auc(out.withColumn("p", F.round("prob", 6)), "p", "y").select(F.round("auc", 3).alias("auc"))


@query("q_frontier", "SELECT DISTINCT l_discount AS target, round(l_discount * (0.2 * 1000 + 0.8 * 500) / (1 - l_discount * 0.0), 6) AS credit FROM lineitem")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """Credit that a target score needs with 1000 dots against 500 truth cells."""
    t = table(spark, d, "lineitem").select(F.col("l_discount").alias("target")).distinct()
    return t.select("target", F.round(s.credit_required(F.col("target"), F.lit(1000.0), F.lit(500.0)), 6).alias("credit"))


@query("q_loo_r2", """WITH s AS (SELECT count(*) n, avg(l_quantity) mx, avg(l_extendedprice) my, var_pop(l_quantity) vx, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a FROM lineitem)
 SELECT n, round(b, 4) AS slope, round(a, 3) AS intercept, round(r2, 6) AS r2, round(l2, 6) AS loo_r2 FROM (SELECT any_value(n) n, any_value(b) b, any_value(a) a, 1 - sum(pow(l_extendedprice - a - b * l_quantity, 2)) / sum(pow(l_extendedprice - my, 2)) r2, 1 - sum(pow((l_extendedprice - a - b * l_quantity) / (1 - 1.0 / n - pow(l_quantity - mx, 2) / (n * vx)), 2)) / sum(pow((l_extendedprice - my) * n / (n - 1), 2)) l2 FROM lineitem, s)""")
def loo_r2(spark: SparkSession, d: str) -> DataFrame:
    got = models.loo_r2(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return got.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), *six("r2", "loo_r2"))


@query("q_gate", "SELECT c_custkey AS card, concat_ws(',', CASE WHEN c_acctbal > 0 THEN NULL ELSE 'balance' END, CASE WHEN c_nationkey < 20 THEN NULL ELSE 'nation' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL ELSE 'segment' END) AS reasons FROM customer")
def gate(spark: SparkSession, d: str) -> DataFrame:
    got = splits.failures(table(spark, d, "customer"), {"balance": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 20, "segment": F.col("c_mktsegment") != "BUILDING"})
    return got.select(F.col("c_custkey").alias("card"), F.array_join("reasons", ",").alias("reasons"))


@query("q_favourability", f"WITH {CELL}, k AS (SELECT r, c, cume_dist() OVER (ORDER BY q) a, cume_dist() OVER (ORDER BY disc) b, cume_dist() OVER (ORDER BY tax) t FROM cell) SELECT r, c, round((a + b) / 2 * t, 6) AS favourability FROM k")
def favourability(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d).select("r", "c", "q", "disc", "tax")
    for v, n in (("q", "a"), ("disc", "b"), ("tax", "t")):
        x = st.percentile_rank(x, v, n)
    return x.select("r", "c", F.round((F.col("a") + F.col("b")) / 2 * F.col("t"), 6).alias("favourability"))


@query("q_block_scores", f"""WITH {MASKS}, {offs(8)}, tk AS (SELECT r + dy r, c + dx c, max(greatest(1 - sqrt(d2) / 3, 0)) k FROM pred, offs GROUP BY 1, 2) SELECT r // 64 AS br, c // 64 AS bc, round(sum(coalesce(k, 0)), 5) AS tp, count(*) AS n FROM truth LEFT JOIN tk USING (r, c) GROUP BY 1, 2""")
def block_scores(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d)
    got = metric.credit(mask(x, "flag = 'R'"), mask(x, "flag = 'A'"))
    return got.groupBy(F.floor(F.col("r") / 64).cast("int").alias("br"), F.floor(F.col("c") / 64).cast("int").alias("bc")).agg(F.round(F.sum("k"), 5).alias("tp"), F.count(F.lit(1)).alias("n"))
