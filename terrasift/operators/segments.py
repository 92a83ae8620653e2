"""Lines as lines: segments of polylines, the tiles they pass, and exact distances to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, stored


def segments_of(vertices: DataFrame) -> DataFrame:
    """(line, seq, r, c, q_r, q_c): consecutive vertices (line, seq, r, c) of each line; a lone vertex is a point."""
    w = Window.partitionBy("line").orderBy("seq")
    both = vertices.select("line", "seq", "r", "c", F.lead("r").over(w).alias("q_r"), F.lead("c").over(w).alias("q_c"), F.count(F.lit(1)).over(Window.partitionBy("line")).alias("_n"))
    return both.where("q_r is not null or _n = 1").select("line", "seq", "r", "c", F.coalesce("q_r", "r").alias("q_r"), F.coalesce("q_c", "c").alias("q_c"))


def distance2(r: Column, c: Column, a_r: Column, a_c: Column, b_r: Column, b_c: Column) -> Column:
    """Squared distance of a point to the segment between two ends."""
    dy, dx = (b_r - a_r).cast("double"), (b_c - a_c).cast("double")
    along = F.coalesce(((r - a_r) * dy + (c - a_c) * dx) / F.nullif(dy * dy + dx * dx, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    y, x = r - a_r - t * dy, c - a_c - t * dx
    return y * y + x * x


def in_tiles(segments: DataFrame, tile: float, reach: float) -> DataFrame:
    """Segments with each tile (tr, tc) that comes within ``reach`` of them, and few more.

    For each row of tiles the segment is cut to the rows within reach, so a long slanting segment takes the tiles
    along it and not those of the rectangle around it.
    """
    r, q = F.col("r").cast("double"), F.col("q_r").cast("double")
    low, high = F.floor((F.least(r, q) - reach) / tile).cast("int"), F.floor((F.greatest(r, q) + reach) / tile).cast("int")
    rows = segments.select("*", F.explode(F.sequence(low, high)).alias("tr"))
    dr, dc = q - r, (F.col("q_c") - F.col("c")).cast("double")
    at = lambda y: F.least(F.greatest(F.coalesce((y - r) / F.nullif(dr, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    # where the segment enters and leaves the rows from ``reach`` before the tile to ``reach`` after it; level ones are whole
    one, other = at(F.col("tr") * tile - reach), at((F.col("tr") + 1) * tile + reach)
    one, other = F.when(dr == 0, 0.0).otherwise(one), F.when(dr == 0, 1.0).otherwise(other)
    c1, c2 = F.col("c") + one * dc, F.col("c") + other * dc
    first, last = F.floor((F.least(c1, c2) - reach) / tile).cast("int"), F.floor((F.greatest(c1, c2) + reach) / tile).cast("int")
    return rows.select("*", F.explode(F.sequence(first, last)).alias("tc"))


def nearest_line(points: DataFrame, segments: DataFrame, extent: float, start: float = 2.0) -> DataFrame:
    """Each distinct point (r, c) with the nearest segment's line, seq and squared distance d2; ties by line, then seq.

    The radius doubles from ``start``: tiles are as wide as it, but no narrower than a cell, points meet segments that pass their tile within it,
    and only points without a segment in reach go on. Beyond ``extent``, or without segments, all three are null.
    Distances are rounded to 9 places before ties are broken. Of segments between the same ends only the first counts.
    """
    todo = stored(points.select("r", "c").distinct())
    first = segments.groupBy("r", "c", "q_r", "q_c").agg(F.min(F.struct("line", "seq")).alias("k"))
    lines = stored(first.select("k.line", "k.seq", "r", "c", "q_r", "q_c"))
    found, reach = None, float(start)
    some = bool(lines.head(1))
    while some:
        tile = max(reach, 1.0)
        there = in_tiles(lines, tile, reach).withColumnsRenamed({"r": "a_r", "c": "a_c"})
        own = todo.select("r", "c", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
        d2 = F.round(distance2(F.col("r"), F.col("c"), F.col("a_r"), F.col("a_c"), F.col("q_r"), F.col("q_c")), 9)
        # a segment's tiles are many times what their plan is taken for: they are never sent to the driver to broadcast
        near = own.join(there.hint("merge"), ["tr", "tc"]).select("r", "c", F.struct(d2.alias("d2"), "line", "seq").alias("k")).where(F.col("k.d2") <= reach * reach)
        got = stored(near.groupBy("r", "c").agg(F.min("k").alias("k")).select("r", "c", "k.line", "k.seq", "k.d2"))
        found = got if found is None else found.unionByName(got)
        last, todo = todo, stored(todo.join(got.select("r", "c"), ["r", "c"], "left_anti"))
        forget(last)
        if reach >= extent or not todo.head(1):
            break
        reach *= 2
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    rest = todo.select("r", "c", F.lit(None).cast(kinds["line"]).alias("line"), F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit(None).cast("double").alias("d2"))
    return rest if found is None else found.unionByName(rest)


def crossing(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments (r, c, q_r, q_c) cross properly; touching ends have distance 0 by ``distance2`` anyway."""
    side = lambda s, r, c: (s[2] - s[0]) * (c - s[1]) - (s[3] - s[1]) * (r - s[0])
    apart = lambda s, o: (side(s, o[0], o[1]) * side(s, o[2], o[3])) < 0
    return apart(a, b) & apart(b, a)


def shortest_breach(pairs: DataFrame, segments: DataFrame, extent: float, start: float = 4.0) -> DataFrame:
    """(a, b, d2) of pairs of lines (a, b): the squared length of the shortest way from one to the other.

    0 where they cross or touch. The radius doubles from ``start``: segments of both lines meet in tiles that the one
    passes within the radius and the other passes itself. Beyond ``extent``, and for lines without segments, d2 is null.
    """
    todo, lines = stored(pairs.select("a", "b").distinct()), stored(segments.select("line", "seq", "r", "c", "q_r", "q_c"))
    names = ("r", "c", "q_r", "q_c")
    found, reach = None, float(start)
    while todo.head(1):
        side = lambda k, near: in_tiles(lines, reach, near).select("tr", "tc", F.col("line").alias(k), F.col("seq").alias(f"{k}_seq"), *[F.col(x).cast("double").alias(f"{k}_{x}") for x in names])  # noqa: B023, E731
        both = todo.join(side("a", reach).hint("merge"), "a").join(side("b", 0.0).hint("merge"), ["b", "tr", "tc"])
        one, other = ([F.col(f"{k}_{x}") for x in names] for k in "ab")
        ends = [distance2(p[i], p[i + 1], *s) for p, s in ((one, other), (other, one)) for i in (0, 2)]
        d2 = F.round(F.when(crossing(one, other), 0.0).otherwise(F.least(*ends)), 9)
        got = stored(both.select("a", "b", d2.alias("d2")).where(F.col("d2") <= reach * reach).groupBy("a", "b").agg(F.min("d2").alias("d2")))
        found = got if found is None else found.unionByName(got)
        last, todo = todo, stored(todo.join(got.select("a", "b"), ["a", "b"], "left_anti"))
        forget(last)
        if reach >= extent:
            break
        reach *= 2
    rest = todo.withColumn("d2", F.lit(None).cast("double"))
    return rest if found is None else found.unionByName(rest)
