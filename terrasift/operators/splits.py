"""Spatial folds, hash-drawn holdouts and promotion checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .neighbours import dilate8, nearest
from .statistics import quantile_cut


def quadrant_folds(cells: DataFrame) -> DataFrame:
    """Adds ``fold`` 0..3, cut at the (integer) median row and column."""
    cut = quantile_cut(quantile_cut(cells, "r", 0.5, "_r"), "c", 0.5, "_c")
    fold = F.when(F.col("r") < F.floor("_r"), 0).otherwise(2) + F.when(F.col("c") < F.floor("_c"), 0).otherwise(1)
    return cut.withColumn("fold", fold.cast("int")).drop("_r", "_c")


def hidden_systems(systems: DataFrame, share: float, seed: int, *by: str) -> DataFrame:
    """Systems (comp) drawn by md5 rank: the first rint(share * n), at least one, of each group."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("comp").cast("string")))
    w = Window.partitionBy(*by)
    ranked = systems.withColumn("_k", F.row_number().over(w.orderBy(order, "comp"))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_k") <= F.greatest(F.rint(F.col("_n") * share), F.lit(1.0))).drop("_k", "_n")


def failures(card: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: the names of checks that do not hold; null counts as not."""
    found = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return card.withColumn("reasons", F.array_compact(found))


def losfo(labelled: DataFrame, row: int, column: int, share: float, seed: int, buffer: int, extent: int) -> DataFrame:
    """Leave systems of one fold out: (fold, hidden, known, separation2), one row per fold that hides something.

    A system (component of ``labelled``) belongs to the quadrant of its rounded centre; md5 ranks draw ``share`` of
    each quadrant's systems (rounded, at least one). Known cells keep ``buffer`` cells away from all hidden
    systems, whatever their fold. ``separation2`` is the least squared distance of a hidden cell to a known one.
    """
    centre = lambda x: F.bround(F.avg(x), 0)
    fold = F.when(centre("r") < row, 0).otherwise(2) + F.when(centre("c") < column, 0).otherwise(1)
    systems = labelled.groupBy("comp").agg(fold.cast("int").alias("fold"))
    held = hidden_systems(systems, share, seed, "fold").select("comp", "fold")
    hidden = stored(labelled.join(held, "comp").select("r", "c", "fold"))
    known = stored(labelled.select("r", "c").join(dilate8(hidden, buffer), ["r", "c"], "left_anti"))
    apart = nearest(hidden, known, extent).groupBy("fold").agg(F.count(F.lit(1)).alias("hidden"), F.min("d2").alias("separation2"))
    total = known.agg(F.count(F.lit(1)).alias("known"))
    return apart.join(F.broadcast(total), F.lit(True)).select("fold", "hidden", "known", "separation2")
