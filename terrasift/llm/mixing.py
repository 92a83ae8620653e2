"""Mixing sources to target weights by weighted fair queueing.

Each document, in shuffled order within its source, gets a virtual finish time: the source's words up
to and with it, divided by the source's target. Taking documents in the order of finish times until the
total budget is spent serves every source in proportion to its target. A source that must be repeated
queues a second time, behind itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Rows of a source that one window sorts, and rows of a range of finish times.
BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds each source's rank from 0, by code point and null last, without sorting all in one task."""
    order = F.col("source").asc_nulls_last()
    ranged = stored(sizes.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(ranged.groupBy("_part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = sizes.sparkSession.createDataFrame(offsets, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from a table of (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. All targets add up to ``share`` times all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by weight,
    until none is above. Each turn of that is one aggregate over the table of sources. ``share`` must not
    be above ``most``.
    """
    if share > most:
        raise ValueError("share above most")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked_sources(sizes).withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        n, used, left = table.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (share * total - (used or 0.0)) / left
    target = F.least(cap, F.lit(level) * F.col("weight")) if left else cap
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Per row of ``df``: its id, source, size, source_size, target, and taken, the words the mix takes of it.

    taken is 0, the size, or twice that (a second turn of the source), and a part of it for the one row at
    which the budget ends. Rows shuffle by a hash of id and text, so reruns agree; equal rows are
    interchangeable. Null and empty texts have size 0 and nothing is taken of them; null sources are one
    source. An empty table gives an empty result. Other columns are left out.

    No source is sorted in one task: its rows fall into blocks of about ``BLOCK_ROWS`` by shuffled order,
    block sums are added up over the table of blocks, and only the rows of one block are sorted together.
    """
    spark = df.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(row_id), F.col(text))
    small = stored(df.select(F.col(row_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("order")))
    blocks = max(1, math.ceil(small.count() / BLOCK_ROWS))
    block = F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * blocks).cast("long")
    small = small.withColumn("block", F.least(block, F.lit(blocks - 1)))

    by_block = stored(small.groupBy("source", "block").agg(F.sum("size").alias("words")))
    targets = source_targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # sums of blocks, then of groups of blocks: no window holds more than the root of a source's blocks by much
    group = F.floor(F.col("block") / F.lit(max(64, math.isqrt(blocks))))
    grouped = by_block.withColumn("group", group)
    earlier = lambda *by, of: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("source", "group").agg(F.sum("words").alias("words")).withColumn("upto", earlier("source", of="group"))
    groups = groups.select(F.col("source").alias("gs"), F.col("group").alias("gk"), "upto")
    inside = grouped.withColumn("inside", earlier("source", "group", of="block"))
    starts = inside.join(groups, F.col("source").eqNullSafe(F.col("gs")) & (F.col("group") == F.col("gk"))).select("source", "block", (F.col("upto") + F.col("inside")).alias("before"))
    starts = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("b.source").alias("s"), F.col("b.block").alias("k"), "before", "source_size", "target")

    upto = F.sum("size").over(Window.partitionBy("source", "block").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0))
    queued = small.withColumn("upto", upto).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    done = F.col("before") + F.col("upto")
    first, second = done / F.col("target"), (F.col("source_size") + done) / F.col("target")
    queued = stored(queued.select("id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "order", F.when(F.col("size") > 0, first).alias("first"), F.when(F.col("size") > 0, second).alias("second")))

    entries = queued.where("size > 0").select(F.posexplode(F.array("first", "second")).alias("turn", "finish"), "order", "id", "size")
    parts = min(10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks))
    key = ["finish", "order", "id", "turn"]
    ranged = stored(entries.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("part").agg(F.sum("size")).collect())
    budget = round(share * sum(n for _, n in sums) / 2)
    spent = 0
    for part, n in sums:
        if spent + n >= budget:
            break
        spent += n
    if not budget:
        return queued.select(F.col("id").alias(row_id), F.col("source").alias(source), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    total = F.sum("size").over(Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)) + spent
    last = ranged.where(F.col("part") == part).withColumn("total", total).where(F.col("total") >= budget).orderBy("total").first()
    cut = F.struct(*[F.lit(last[k]).cast(ranged.schema[k].dataType).alias(k) for k in key])

    def part_of(finish: str, turn: int) -> Column:
        own = F.struct(F.col(finish).alias("finish"), "order", "id", F.lit(turn).alias("turn"))
        return F.when(own < cut, F.col("size")).when(own == cut, F.lit(budget - (last["total"] - last["size"]))).otherwise(0)

    taken = F.coalesce(part_of("first", 0) + part_of("second", 1), F.lit(0))
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return queued.select(F.col("id").alias(row_id), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"))
