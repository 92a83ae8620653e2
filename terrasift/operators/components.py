"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored
from .neighbours import offsets, spread

TILE = 256


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of a table of edges (a, b); the root is the least node of its component.

    Only sums come to the driver. Each round ends in a stored table. Self-loops and repeated edges are fine;
    an empty table has no nodes.
    """
    now = stored(_pairs(edges))
    state = _state(now)
    while state[0]:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = stored(_pairs(both.join(least, F.col("a") == F.col("node")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))))
        # small star: a node and its neighbours below go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        lower = large.join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(_pairs(lower.unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))))
        forget(last, large)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def label8(mask: DataFrame, width: int, most_d2: int = 2) -> DataFrame:
    """Adds ``comp``, the least flat id (r * width + c) of each cell's component; 8 neighbours by default.

    Each tile labels its own cells. Only labels that meet across a seam become edges, so rounds over edges see as many
    rows as there are such meetings, not cells.
    """
    cells = mask.select("r", "c").distinct()
    reach = math.isqrt(most_d2)
    around = [(y, x) for y, x, _ in offsets(most_d2, 1)]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = dict.fromkeys(sorted(zip(pdf.r.tolist(), pdf.c.tolist(), strict=True)))
        found = {}
        for start in todo:
            if start in found:
                continue
            found[start] = own = start[0] * width + start[1]
            line = [start]
            while line:
                r, c = line.pop()
                for y, x in around:
                    n = (r + y, c + x)
                    if n in todo and n not in found:
                        found[n] = own
                        line.append(n)
        r, c = zip(*found, strict=True)
        return pd.DataFrame({"r": r, "c": c, "part": list(found.values())})

    tile = lambda x: F.floor(F.col(x) / TILE)
    parts = stored(cells.groupBy(tile("r").alias("tr"), tile("c").alias("tc")).applyInPandas(label, "r int, c int, part long"))
    near = lambda x: (F.pmod(F.col(x), F.lit(TILE)) < reach) | (F.pmod(F.col(x), F.lit(TILE)) >= TILE - reach)
    seam = parts.where(near("r") | near("c"))
    half = [o for o in offsets(most_d2, 1) if (o[0], o[1]) > (0, 0)]
    edges = spread(seam.withColumnRenamed("part", "a"), half).select("r", "c", "a").join(seam.withColumnRenamed("part", "b"), ["r", "c"]).where("a <> b").select("a", "b").distinct()
    found = components(edges)
    return parts.join(found, F.col("part") == F.col("node"), "left").select("r", "c", F.coalesce("root", "part").alias("comp"))
