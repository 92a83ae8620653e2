"""Ranks, robust scales, correlations and resampling over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import kernel
from ..storage import stored
from .neighbours import KERNEL, spread


def running_sums(df: DataFrame, key: str, amounts: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for each amount, its sum over all rows up to this one by distinct ``key``; names are the dict's values.

    Rows are dealt by ranges of the key; one sum per range goes to the driver and back, so no task sorts it all.
    """
    order = F.desc(key) if descending else F.asc(key)
    ranged = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before, starts = [0] * len(amounts), []
    for part, *sums in sorted(ranged.groupBy("_part").agg(*[F.sum(a) for a in amounts]).collect()):
        starts.append((part, *before))
        before = [x + y for x, y in zip(before, sums, strict=True)]
    if not starts:  # an empty table
        return df.select(*df.columns, *[F.lit(0).cast("long").alias(n) for n in amounts.values()])
    table = df.sparkSession.createDataFrame(starts, ", ".join(["_part int", *(f"_before{i} long" for i in range(len(amounts)))]))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(table), "_part")
    return out.select(*df.columns, *[(F.sum(a).over(w) + F.col(f"_before{i}")).alias(n) for i, (a, n) in enumerate(amounts.items())])


def numbered(df: DataFrame, *order: str, name: str = "n", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``, each row's place from 0 in an order, and running sums in that order (column: name).

    Rows are dealt by ranges of the order and numbered within; one count and sum a range goes to the driver and back.
    Give an order in which no two rows are equal, or equal rows are alike.
    """
    sums = sums or {}
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, starts = [0, *(0.0 for _ in sums)], []
    for part, *more in sorted(ranged.groupBy("_part").agg(F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0)).cast("double") for x in sums]).collect()):
        starts.append((part, *before))
        before = [x + y for x, y in zip(before, more, strict=True)]
    names = ["_part int", "_first long", *(f"_sum{i} double" for i in range(len(sums)))]
    table = df.sparkSession.createDataFrame(starts or [(0, 0, *(0.0 for _ in sums))], ", ".join(names))
    out = ranged.join(F.broadcast(table), "_part")
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(*df.columns, (F.col("_first") + F.col("_at")).alias(name), *[(F.sum(F.coalesce(x, F.lit(0))).over(w) + F.col(f"_sum{i}")).alias(n) for i, (x, n) in enumerate(sums.items())])


def ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average ranks from 1, from counts of distinct values."""
    levels = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    levels = running_sums(levels, "_v", {"_n": "_upto"}).select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(levels, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of rows at or below each value; null stays null."""
    levels = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(df.agg(F.count(value).alias("_total")))
    levels = running_sums(levels, value, {"_n": "_upto"}).join(total, F.lit(True))
    return df.join(levels.select(value, (F.col("_upto") / F.col("_total")).alias(name)), value, "left")


def with_constants(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Joins a one-row aggregate of the table to each of its rows."""
    return df.join(F.broadcast(df.agg(*aggregates)), F.lit(True))


def robust_unit(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95, name: str = "unit") -> DataFrame:
    """Scaled so that the quantiles become 0 and 1, clipped; a degenerate spread gives 0."""
    both = quantile_cuts(df, value, {"_lo": low, "_hi": high})
    scaled = F.least(F.greatest((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)), F.lit(1.0))
    return both.withColumn(name, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(0.0)).drop("_lo", "_hi")


def mad_scale(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """(v - median) / (1.4826 * MAD); 0 where the MAD is 0."""
    one = quantile_cut(df, value, 0.5, "_med")
    two = quantile_cut(one.withColumn("_dev", F.abs(F.col(value) - F.col("_med"))), "_dev", 0.5, "_mad")
    return two.withColumn(name, F.when(F.col("_mad") > 0, (F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad"))).otherwise(0.0)).drop("_med", "_dev", "_mad")


def robust_scale(df: DataFrame, value: str, name: str, where: Column | None = None) -> DataFrame:
    """Adds 1.4826 times the median deviation of a column, its standard deviation where that is 0, 1 where both are.

    With ``where``, over the rows that it holds for; the median is added as ``name`` + "_at".
    """
    part = (df if where is None else df.where(where)).select(value)
    one = stored(quantile_cut(part, value, 0.5, "_m").withColumn("_d", F.abs(F.col(value) - F.col("_m"))))
    two = quantile_cut(one, "_d", 0.5, "_w").agg(F.max("_m").alias(f"{name}_at"), F.max("_w").alias("_w"), F.stddev_pop(value).alias("_s"))
    found = two.select(f"{name}_at", F.when(F.col("_w") > 0, 1.4826 * F.col("_w")).when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias(name))
    return df.join(F.broadcast(found), F.lit(True))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with averaged ties; null for a constant side."""
    both = ranks(ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return both.agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area under the curve of a 0/1 label; null unless both occur."""
    r = ranks(df.select(score, label), score, "_r")
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    area = (F.sum(F.col("_r") * F.col(label)) - pos * (pos + 1) / 2) / (pos * neg)
    return r.agg(F.when((pos > 0) & (neg > 0), area).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over distinct scores, from the top, of precision times the recall gained."""
    levels = df.groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    upto = running_sums(levels, score, {"p": "hits", "n": "all"}, descending=True)
    return upto.agg((F.sum(F.col("hits") / F.col("all") * F.col("p")) / F.sum("p")).alias("ap"))


def hash_draw(*parts: Column) -> Column:
    """A draw in [0, 1) from the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap(blocks: DataFrame, value: str, block: str, m: int, times: int, seed: int) -> DataFrame:
    """Resampled means of a table of blocks with ids in 0..m-1: (lo, hi), the 2.5 % and 97.5 % quantiles.

    Draw j of resample i is block floor(m * u), with u from md5(seed | i | j); draws of empty blocks do not count.
    """
    spark = blocks.sparkSession
    draws = spark.range(times).withColumnRenamed("id", "i").select("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    drawn = draws.select("i", F.floor(hash_draw(F.lit(seed), F.col("i"), F.col("j")) * m).cast("long").alias(block))
    means = drawn.join(blocks.select(F.col(block).cast("long").alias(block), value), block).groupBy("i").agg(F.avg(value).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))


def hash_ranked(df: DataFrame, seed: int, key: str, *by: str) -> DataFrame:
    """Adds ``draw``, the row's place in a hash-random order (within ``by``)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(order, key)))


def surface_against_masks(surface: DataFrame, value: str, masks: DataFrame, by: str, top: int) -> DataFrame:
    """Per mask (rows of equal ``by``): rank correlation with a surface over its cells, and how many of the top cells it has.

    The surface is ranked once. A mask's correlation needs only sums over its own cells, so no cell meets every mask.
    """
    ranked = ranks(surface.select("r", "c", value), value, "_rank")
    best = surface.orderBy(F.desc(value), "r", "c").limit(top).select("r", "c", F.lit(1).alias("_top"))
    whole = ranked.agg(F.count(F.lit(1)).alias("_n"), F.avg("_rank").alias("_m"), F.var_pop("_rank").alias("_v"))
    inside = masks.select(by, "r", "c").distinct().join(ranked, ["r", "c"]).join(best, ["r", "c"], "left")
    sums = inside.groupBy(by).agg(F.count(F.lit(1)).alias("_k"), F.sum("_rank").alias("_s"), F.count("_top").alias("top_inside"))
    both = masks.select(by).distinct().join(sums, by, "left").join(F.broadcast(whole), F.lit(True))
    share = F.col("_k") / F.col("_n")
    rho = (F.col("_s") / F.col("_n") - F.col("_m") * share) / F.sqrt(F.col("_v") * share * (1 - share))
    return both.select(by, F.when((F.col("_v") > 0) & share.between(1e-12, 1 - 1e-12), rho).alias("rho"), F.coalesce("top_inside", F.lit(0)).cast("long").alias("top_inside"))


def blind_credit(dots: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """Per dot set: dots, cells of the base, and the mean credit of a base cell if truth were anywhere on it."""
    reach = spread(dots.select(by, "r", "c"), KERNEL).groupBy(by, "r", "c").agg(F.max(kernel(F.col("d2"))).alias("_k"))
    credit = reach.join(base.select("r", "c"), ["r", "c"], "left_semi").groupBy(by).agg(F.sum("_k").alias("_credit"))
    count = dots.groupBy(by).agg(F.count(F.lit(1)).alias("dots"))
    both = count.join(credit, by).join(F.broadcast(base.agg(F.count(F.lit(1)).alias("cells"))), F.lit(True))
    return both.select(by, "dots", "cells", (F.col("_credit") / F.col("cells")).alias("blind_credit"))


def quantile_cuts(df: DataFrame, value: str, cuts: dict[str, float]) -> DataFrame:
    """Joins quantiles of a column (name: share, linear between ranks) to each row; null where the column is empty.

    Counts of distinct values are added up over ranges of the value, so no task holds them all, and two values
    a quantile come out: the ranks at either side.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(levels, "_v", {"_n": "_upto"})
    both = upto.join(F.broadcast(upto.agg(F.max("_upto").alias("_total"))), F.lit(True))
    found = []
    for name, at in cuts.items():
        place = (F.col("_total") - 1) * F.lit(float(at))
        low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v")))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return df.join(F.broadcast(both.agg(*found)), F.lit(True))


def quantile_cut(df: DataFrame, value: str, at: float, name: str = "_cut") -> DataFrame:
    return quantile_cuts(df, value, {name: at})
