"""Gates, masks with checks, closed forms, sinks and registry comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import gates, neighbours as nb, statistics as st
from ..sources import files
from ..sources.cells import cells, mask, table
from .cell_queries import VERTEX, six
from .place_queries import REGISTRY, registry
from .registry import CELL, MASKS, offs, query


def run_cards(spark: SparkSession, d: str) -> DataFrame:
    """A run card per customer; the customer's key decides which of its fields are at fault."""
    k = F.col("c_custkey")
    fault = lambda m: k % m == 0
    sha = lambda *x: F.sha2(F.concat_ws(":", *[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x]), 256)
    raster = sha("raster", k)
    member = [sha("member", k, F.lit(i)) for i in range(2)]
    row = lambda m, rho, near: F.struct(m.alias("raster_sha256"), rho.cast("double").alias("spearman"), near.cast("double").alias("within_3px_fraction"))
    no = F.lit(None).cast("double")
    holdout = F.struct(
        F.when(fault(7), "").otherwise(raster).alias("raster_sha256"), F.when(fault(17), "abc").otherwise(sha("base", k)).alias("baseline_sha256"), F.lit("holdout-score").alias("label"),
        F.when(fault(19), "v0").otherwise("segment-pooled-v1").alias("evaluator_version"), (k % 5).cast("int").alias("withheld_positives"), F.when(fault(23), no).otherwise(0.5).alias("dti"),
        F.array(F.lit(0.25), F.when(fault(29), 0.375).otherwise(0.75)).alias("ci95"), F.lit(0.25).alias("baseline_dti"), F.when(fault(31), 0.5).otherwise(0.25).alias("paired_gain"),
        F.array(F.when(fault(37), -0.125).otherwise(0.125), F.lit(0.625)).alias("paired_gain_ci95"), *[(~fault(41 + i)).alias(p) for i, p in enumerate(gates.PROTOCOL)],
        F.lit(0.2).alias("alpha"), F.lit(0.8).alias("beta"), F.when(fault(47), 200).otherwise(300).alias("kernel_m"), F.lit("triangular").alias("kernel"),
    )
    surface = F.array(row(member[0], F.lit(0.5), no), row(F.when(fault(53), member[0]).otherwise(member[1]), F.lit(0.25), F.when(fault(59), 0.75).otherwise(no)))
    dots = F.array(row(member[0], F.when(fault(61), 0.95).otherwise(0.5), F.lit(0.5)), row(member[1], F.lit(-0.5), F.when(fault(67), no).otherwise(0.25)))
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(fault(11), "  ").otherwise("lane").alias("lane"), raster.alias("raster_sha256"), F.lit("name").alias("submission_name"), F.repeat(F.lit("x"), (k % 160).cast("int")).alias("note"),
        F.lit("h").alias("hypothesis"), F.lit("m").alias("mechanism"), F.when(~fault(13), "mimic").alias("non_fault_mimic"), holdout.alias("holdout"),
        F.array(F.lit("a"), F.when(fault(71), "a").otherwise("b")).alias("feature_names"), F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.when(fault(73), 0.95).otherwise(0.75)).alias("feature_canaries"),
        F.struct((~fault(79)).alias("complete"), sha("manifest", k).alias("manifest_sha256"), F.array(*member).alias("members"), surface.alias("surface"), dots.alias("dots")).alias("registry"),
        F.struct(raster.alias("raster_sha256"), *[(~fault(83 + i)).alias(c) for i, c in enumerate(gates.VALIDATED)]).alias("validator"),
    )


def _case(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"CASE WHEN {test} THEN '{reason}' END" for test, reason in pairs)


_FAULT = lambda m: f"k % {m} = 0"
_PROMOTION = _case(
    (_FAULT(11), "missing assigned method lane"), ("k % 160 NOT BETWEEN 1 AND 140", "note must contain 1 to 140 characters"), (_FAULT(13), "missing hypothesis, mechanism or confounder"), (_FAULT(7), "holdout raster hash mismatch"),
    (_FAULT(17), "missing frozen baseline hash"), (_FAULT(19), "not the shared evaluator"), (_FAULT(5), "missing withheld positives"), (_FAULT(23), "invalid holdout score"), ("k % 23 = 0 OR k % 29 = 0", "invalid holdout interval"),
    ("k % 23 = 0 OR k % 31 = 0", "gain is not candidate minus baseline, or not positive"), (_FAULT(37), "no positive interval around the gain"), *[(_FAULT(41 + i), f"protocol missing: {p}") for i, p in enumerate(gates.PROTOCOL)],
    (_FAULT(47), "wrong metric protocol"), (_FAULT(71), "missing or invalid feature list"), (_FAULT(71), "canaries must cover every feature exactly"), (_FAULT(73), "invalid or leaking feature: b"), (_FAULT(79), "registry incomplete"),
    (_FAULT(59), "surface overlap duplicate or undefined"), (_FAULT(53), "surface comparisons must cover every member once"), (_FAULT(61), "dots correlation duplicate or undefined"), (_FAULT(67), "dots overlap duplicate or undefined"),
    *[(_FAULT(83 + i), f"validator failed: {c}") for i, c in enumerate(gates.VALIDATED)],
)


@query("q_promotion_gate", f"WITH t AS (SELECT c_custkey k FROM customer), f AS (SELECT k, concat_ws('; ', {_PROMOTION}) reasons FROM t) SELECT k AS id, reasons, reasons = '' AS promoted FROM f")
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    got = gates.promotion_gate(run_cards(spark, d))
    return got.select("id", F.array_join("failures", "; ").alias("reasons"), "promoted")


_PREFLIGHT = _case(
    ("k % 11 = 0", "missing lane or its source"), ("k % 13 = 0 OR n IS NULL", "registry is not complete with members"), ("bad > 0", "registry member missing or changed"), ("kinds < found", "registry member repeated"),
    ("k % 17 = 0", "baseline under another protocol"), ("k % 19 = 0", "baseline lacks score, interval or count"), ("k % 9 IN (0, 8)", "time budget invalid"), ("k % 5 >= 3", "experiment budget exhausted or invalid"),
    ("(k % 9) * 1000 <= k % 3000", "time used up or start in the future"), ("k % 23 = 0", "a slot must not be selected"),
)


@query("q_preflight_gate", f"""WITH t AS (SELECT c_custkey k FROM customer), m AS (SELECT o_custkey k, 'p' || o_orderkey % 60 path, CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE sha256('content ' || (o_orderkey % 60) % 50) END want FROM orders),
 f AS (SELECT 'p' || i path, sha256('content ' || i % 50) have FROM (SELECT unnest(range(58)) i)), s AS (SELECT k, count(*) n, count(*) - count_if(coalesce(have = want, false)) bad, count(DISTINCT have) kinds, count(have) found FROM m LEFT JOIN f USING (path) GROUP BY 1),
 r AS (SELECT k, concat_ws('; ', {_PREFLIGHT}) reasons FROM t LEFT JOIN s USING (k)) SELECT k AS plan_id, reasons, reasons = '' AS allowed FROM r""")
def preflight_gate(spark: SparkSession, d: str) -> DataFrame:
    """A plan per customer, whose orders are registry members; contents are a small table of files, two of them copies of others and two missing."""
    k = F.col("c_custkey")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    bad = k % 19 == 0
    baseline = F.struct(F.lit("holdout-score").alias("label"), F.lit("segment-pooled-v1").alias("evaluator_version"), (k % 17 != 0).alias("strict"), F.lit(0.5).alias("dti"), F.array(F.lit(0.25), F.lit(0.75)).alias("ci95"), F.when(bad, 0).otherwise(9).alias("withheld_positives"))
    plans = table(spark, d, "customer").select(
        k.alias("plan_id"), F.lit("lane").alias("lane"), F.when(k % 11 != 0, "owner").alias("lane_source"), (k % 13 != 0).alias("registry_complete"), baseline.alias("baseline"), ((k % 9) * 1000).alias("cap"),
        (k % 5).cast("int").alias("experiments_run"), F.lit(3).alias("experiment_cap"), F.timestamp_seconds(1_700_000_000 - k % 3000).alias("started_at"), (k % 23 == 0).alias("slot_selected"),
    ).withColumn("time_cap_seconds", F.when(F.col("cap") == 0, F.lit(None)).otherwise(F.col("cap")).cast("int")).drop("cap")
    o = F.col("o_orderkey")
    digest = F.sha2(F.concat(F.lit("content "), ((o % 60) % 50).cast("string")), 256)
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("plan_id"), F.concat(F.lit("p"), (o % 60).cast("string")).alias("path"), F.when(o % 31 == 0, "x").otherwise(digest).alias("sha256"))
    contents = spark.range(58).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("content "), (F.col("id") % 50).cast("string")).cast("binary").alias("content"))
    got = gates.preflight_gate(plans, members, contents, now)
    return got.select("plan_id", F.array_join("failures", "; ").alias("reasons"), "allowed")


@query("q_dot_mask", f"WITH {CELL} SELECT r, c FROM cell WHERE q / 50 > 0.5")
def dot_mask(spark: SparkSession, d: str) -> DataFrame:
    """Dots above one half; a value that is missing or outside 0..1 stops the job."""
    return nb.checked_dots(cells(spark, d).select("r", "c", (F.col("q") / 50).alias("p")), "p")


@query("q_point_mask", "WITH p AS (SELECT CAST(c_custkey * 7 % 300 - 20 AS INTEGER) r, CAST(c_custkey * 13 % 300 - 20 AS INTEGER) c FROM customer) SELECT DISTINCT 'clip' AS rule, greatest(least(r, 255), 0) AS r, greatest(least(c, 255), 0) AS c FROM p UNION ALL SELECT DISTINCT 'drop', r, c FROM p WHERE r BETWEEN 0 AND 255 AND c BETWEEN 0 AND 255")
def point_mask(spark: SparkSession, d: str) -> DataFrame:
    """Cells of points, strays moved to the edge or left out."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select((k * 7 % 300 - 20).cast("int").alias("r"), (k * 13 % 300 - 20).cast("int").alias("c"))
    clip, drop = (nb.point_mask(p, 256, 256, rule == "clip").select(F.lit(rule).alias("rule"), "r", "c") for rule in ("clip", "drop"))
    return clip.unionByName(drop)


_COPIES = "reg2 AS (SELECT * FROM reg UNION ALL SELECT f + 9, r, c FROM reg WHERE f < 3)"


@query("q_duplicates", f"WITH {REGISTRY}, {_COPIES}, {offs(9)}, s AS (SELECT DISTINCT f, r + dy r, c + dx c FROM reg2, offs), n AS (SELECT f, count(*) n FROM reg2 GROUP BY 1), k AS (SELECT a.f file_a, s.f file_b, count(*) / max(n.n)::DOUBLE share FROM reg2 a JOIN s ON a.r = s.r AND a.c = s.c AND a.f <> s.f JOIN n ON n.f = a.f GROUP BY 1, 2) SELECT file_a, file_b, round(share, 9) AS share FROM k WHERE share > 0.7")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of files that the duplicate rule refuses: overlap above 0.70."""
    reg = registry(spark, d)
    reg = reg.unionByName(reg.where("f < 3").withColumn("f", F.col("f") + 9))
    near = nb.spread(reg.withColumnRenamed("f", "g"), nb.WITHIN3).select("g", "r", "c").distinct()
    n = reg.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    share = reg.join(near, ["r", "c"]).where("f <> g").groupBy("f", "g").agg(F.count(F.lit(1)).alias("inside")).join(n, "f").select("f", "g", (F.col("inside") / F.col("n")).alias("share"))
    return share.where(s.is_duplicate(F.col("share"))).select(F.col("f").alias("file_a"), F.col("g").alias("file_b"), F.round("share", 9).alias("share"))


@query("q_surface_registry", f"""WITH {CELL}, {REGISTRY}, fs AS (SELECT DISTINCT f FROM reg), s AS (SELECT r, c, v, row_number() OVER (ORDER BY v DESC, r, c) place, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 rv FROM cell),
 x AS (SELECT f, s.*, CASE WHEN reg.r IS NULL THEN 0 ELSE 1 END hit FROM fs CROSS JOIN s LEFT JOIN reg USING (f, r, c)) SELECT f AS file, round(corr(rv, hit), 6) AS rho, CAST(sum(CASE WHEN place <= 2000 THEN hit ELSE 0 END) AS BIGINT) AS top_inside FROM x GROUP BY 1""")
def surface_registry(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a surface with each registered dot set, and how many of its 2,000 highest cells each has."""
    x = cells(spark, d).select("r", "c", "v")
    return st.surface_against_masks(x, "v", registry(spark, d), "f", 2000).select(F.col("f").alias("file"), F.round("rho", 6).alias("rho"), "top_inside")


_KSUM = sum(max(1 - (y * y + x * x) ** 0.5 / 3, 0) for y in range(-3, 4) for x in range(-3, 4))


@query("q_inversion", f"""WITH {CELL}, {offs(8)}, {REGISTRY}, n AS (SELECT f, count(*) n FROM reg GROUP BY 1), k AS (SELECT f, r, c, max(1 - sqrt(d2) / 3) k FROM (SELECT f, r + dy r, c + dx c, d2 FROM reg, offs) SEMI JOIN cell USING (r, c) GROUP BY 1, 2, 3),
 t AS (SELECT f, sum(k) / (SELECT count(*) FROM cell) cs FROM k GROUP BY 1), a AS (SELECT f, n, cs, n * {_KSUM!r} / (SELECT count(*) FROM cell) a, 0.01 + f * 0.001 score FROM n JOIN t USING (f))
 SELECT f AS file, n AS dots, round(cs, 9) AS blind_credit, round(a / cs, 6) AS mass_ratio, round(score * 0.2 * n / (cs - score * (0.2 * (cs - a) + 0.8)), 3) AS g FROM a""")
def inversion(spark: SparkSession, d: str) -> DataFrame:
    """Truth size that a blind probe's score implies, per registered dot set; a stand-in score per file."""
    base = cells(spark, d).select("r", "c")
    got = st.blind_credit(registry(spark, d), base, "f")
    area = F.col("dots") * F.lit(_KSUM) / F.col("cells")
    score = 0.01 + F.col("f") * 0.001
    return got.select(F.col("f").alias("file"), "dots", F.round("blind_credit", 9).alias("blind_credit"), F.round(area / F.col("blind_credit"), 6).alias("mass_ratio"), F.round(s.truth_from_blind(score, F.col("dots"), F.col("blind_credit"), area), 3).alias("g"))


@query("q_credit_fraction", "SELECT c_custkey AS id, round((c_custkey % 100) / 100.0 * (0.8 + 0.2 * (c_custkey % 7)), 9) AS credit FROM customer")
def credit_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Credit fraction that a score and a size ratio imply: the closed form, where a bisection would search."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.round(s.credit_fraction(k % 100 / 100.0, k % 7), 9).alias("credit"))


@query("q_eligible_clusters", f"""WITH {CELL}, g AS (SELECT CAST(l_suppkey AS BIGINT) id, CAST(avg(l_partkey % 256) AS INTEGER) r0, count(*) n, max(l_quantity) depth, min(l_discount) mad FROM lineitem GROUP BY 1),
 k AS (SELECT id, CAST(id * 37 % 256 AS INTEGER) r, CAST(id * 91 % 256 AS INTEGER) c, n, depth, mad FROM g WHERE mad <= 0.02 AND depth <= 50 AND n >= 8) SELECT id, k.r, k.c, k.n FROM k JOIN cell ON cell.r = k.r AND cell.c = k.c WHERE q >= 25""")
def eligible_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose scatter, depth and size pass, on supported cells."""
    k = F.col("l_suppkey")
    found = table(spark, d, "lineitem").groupBy(k.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("depth"), F.min("l_discount").alias("mad"))
    at = found.withColumn("r", (F.col("id") * 37 % 256).cast("int")).withColumn("c", (F.col("id") * 91 % 256).cast("int"))
    return nb.eligible_rows(at, mask(cells(spark, d), "q >= 25"), (F.col("mad") <= 0.02) & (F.col("depth") <= 50) & (F.col("n") >= 8)).select("id", "r", "c", "n")


@query("q_design_matrix", f"WITH {MASKS}, {offs(16)}, k AS (SELECT r + dy r, c + dx c, min(d2) d2 FROM truth, offs GROUP BY 1, 2), n3 AS (SELECT r + dy r, c + dx c, count(*) boxed FROM truth, offs WHERE abs(dy) <= 2 AND abs(dx) <= 2 GROUP BY 1, 2) SELECT r, c, round(sqrt(coalesce(d2, 25)), 9) AS dist, round(coalesce(boxed, 0) / 25.0, 9) AS near, round(r / 255.0, 9) AS y, round(c / 255.0, 9) AS x FROM cell LEFT JOIN k USING (r, c) LEFT JOIN n3 USING (r, c)")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the catalogue (5 beyond 4), its density nearby, and coordinates, per cell; one vector column for a model."""
    x = cells(spark, d)
    got = nb.design_matrix(x.select("r", "c"), mask(x, "flag = 'R'"), 256, 256, reach=4, box=2)
    return got.select("r", "c", *[F.round(F.col("features")[i], 9).alias(n) for i, n in enumerate(("dist", "near", "y", "x"))])


@query("q_all_layers", f"WITH {CELL}, site AS (SELECT CAST(c_custkey * 7 % 256 AS INTEGER) r, CAST(c_custkey * 13 % 256 AS INTEGER) c, max(c_acctbal) temp FROM customer GROUP BY 1, 2), {VERTEX}, line AS (SELECT r, c, count(*) n FROM vertex GROUP BY 1, 2) SELECT cell.r, cell.c, cell.v, cell.q, site.temp, coalesce(line.n, 0) AS vertices FROM cell LEFT JOIN site USING (r, c) LEFT JOIN line USING (r, c)")
def all_layers(spark: SparkSession, d: str) -> DataFrame:
    """All layers side by side on the cells of the first."""
    from ..sources.cells import sites, vertices

    bands = cells(spark, d).select("r", "c", "v", "q")
    site = sites(spark, d).groupBy("r", "c").agg(F.max("temp").alias("temp"))
    line = vertices(spark, d).groupBy("r", "c").agg(F.count(F.lit(1)).alias("vertices"))
    return files.layers(bands, site, line).withColumn("vertices", F.coalesce("vertices", F.lit(0)))


@query("q_heat_flow_scan", "SELECT c_custkey AS fid, CAST(c_custkey * 7 % 256 AS INTEGER) AS r, CAST(c_custkey * 13 % 256 AS INTEGER) AS c, c_acctbal AS hf_resid FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_custkey * 7 % 256 < 200")
def heat_flow_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records of a nested JSON document: one layer, residual at least the cut, first vertex inside the window."""
    k = F.col("c_custkey")
    point = F.array(F.array(F.array((k * 13 % 256).cast("double"), (k * 7 % 256).cast("double"))))
    record = F.struct(k.alias("fid"), F.col("c_mktsegment").alias("source_layer"), point.alias("parts"), F.col("c_acctbal").alias("hf_resid"))
    documents = table(spark, d, "customer").select(F.to_json(F.struct(F.array(record).alias("records"))).alias("json"))
    got = files.residual_records(documents, "json", "BUILDING", 1000.0, (0, 0, 200, 256))
    return got.select("fid", "r", "c", "hf_resid")


@query("q_trace_scan", f"WITH {VERTEX}, ok AS (SELECT line FROM vertex GROUP BY 1 HAVING line % 3 <> 0), seg AS (SELECT line, seq, r, c, lead(r) OVER w q_r, lead(c) OVER w q_c FROM vertex SEMI JOIN ok USING (line) WINDOW w AS (PARTITION BY line ORDER BY seq)), st AS (SELECT *, greatest(abs(q_r - r), abs(q_c - c)) n FROM seg WHERE q_r IS NOT NULL) SELECT line, seq, CAST(i AS INTEGER) AS step, round(r + (q_r - r) * i / greatest(n, 1)::DOUBLE, 6) AS y, round(c + (q_c - c) * i / greatest(n, 1)::DOUBLE, 6) AS x FROM (SELECT *, unnest(range(0, greatest(n, 1))) i FROM st)")
def trace_scan(spark: SparkSession, d: str) -> DataFrame:
    """Traces that have both tendencies, densified to steps of one cell; a third of the lines lack one and go."""
    from ..sources.cells import vertices

    v = vertices(spark, d)
    tendency = v.select("line").distinct().select("line", F.lit(0.5).alias("ts"), F.when(F.col("line") % 3 != 0, 0.5).alias("td"))
    return files.dense_traces(v, tendency).select("line", F.col("seq").cast("long").alias("seq"), "step", *six("y", "x"))


@query("q_band_pack", f"WITH {CELL}, {offs(15)}, m AS (SELECT avg(v) mv, stddev_pop(v) sv FROM cell), k AS (SELECT r + dy r, c + dx c, min(d2) d2 FROM cell, offs WHERE q >= 49 GROUP BY 1, 2) SELECT r, c, round((v - mv) / sv, 6) AS v_z, round(ln(1 + q), 6) AS q_log, round(disc / (tax + 0.01), 6) AS ratio, round(sqrt(coalesce(d2, 16)), 6) AS dist FROM cell CROSS JOIN m LEFT JOIN k USING (r, c)")
def band_pack(spark: SparkSession, d: str) -> DataFrame:
    """Derived bands in one select: a standard score, a logarithm, a ratio, and a clipped distance."""
    x = cells(spark, d)
    near = nb.near_distance(x.select("r", "c", "v", "q", "disc", "tax"), mask(x, "q >= 49"), 15)
    z = st.with_constants(near, F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return z.select("r", "c", F.round((F.col("v") - F.col("_m")) / F.col("_s"), 6).alias("v_z"), F.round(F.log1p("q"), 6).alias("q_log"), F.round(F.col("disc") / (F.col("tax") + 0.01), 6).alias("ratio"), F.round(F.sqrt(F.coalesce("d2", F.lit(16))), 6).alias("dist"))


@query("q_verified_sink", f"WITH {CELL} SELECT count(*) AS cells, count(*) AS read_back, true AS passed FROM cell")
def verified_sink(spark: SparkSession, d: str) -> DataFrame:
    """A surface checked, written beside its place, read back, compared and only then put in place."""
    x = cells(spark, d).select("r", "c", (F.col("q") / 50).alias("p"))
    return files.verified_write(x, "p", files.fresh_path(spark, "surface"))


@query("q_feature_cache", f"WITH {CELL} SELECT r, c, v, q FROM cell")
def feature_cache(spark: SparkSession, d: str) -> DataFrame:
    """Features read from a cache named by the hash of what made them; made when there is none."""
    make = lambda: cells(spark, d).select("r", "c", "v", "q")
    return files.cached(spark, files.fresh_path(spark, "features"), ["cells", d, "256"], make)


@query("q_derived_sink", f"WITH {VERTEX} SELECT line, count(*) AS n FROM vertex GROUP BY 1")
def derived_sink(spark: SparkSession, d: str) -> DataFrame:
    """A derived table written as flat CSV and read back."""
    from ..sources.cells import vertices

    path = files.fresh_path(spark, "derived")
    files.write_derived(vertices(spark, d).groupBy("line").agg(F.count(F.lit(1)).alias("n")), path, "csv")
    return spark.read.schema("line long, n long").option("header", True).csv(path)


@query("q_argument", """SELECT c_custkey AS id, 'Closing this ' || printf('%.2f', c_custkey % 100 / 4.0) || ' km gap joins systems ' || c_custkey || ' and ' || c_nationkey || ' of ' || printf('%.2f', c_custkey % 7 * 1.0) || ' km and ' || printf('%.2f', c_custkey % 5 * 0.5) || ' km into one of ' || printf('%.2f', c_custkey % 9 * 1.25) || ' km; connectivity changes by '
 || printf('%+.4f', c_custkey % 3 * 0.0625) || ' and the largest system''s share by ' || printf('%+.5f', c_custkey % 4 * 0.03125) || '. ' || CASE WHEN c_custkey % 2 = 0 THEN 'It is a bridge: no other candidate link joins these two sides.' ELSE 'It is no bridge: another candidate link joins these two sides already.' END AS argument FROM customer""")
def argument(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = gates.graph_argument(k % 100 / 4.0, k, F.col("c_nationkey"), k % 7 * 1.0, k % 5 * 0.5, k % 9 * 1.25, k % 3 * 0.0625, k % 4 * 0.03125, k % 2 == 0)
    return table(spark, d, "customer").select(k.alias("id"), text.alias("argument"))
