"""Bootstraps of any unit by Poisson weights: all resamples in one pass, whatever the number of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a unit above this have a chance below 1e-12.
_MOST = 15
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(_MOST)])


def weights(unit: np.ndarray, times: int, seed: int) -> np.ndarray:
    """Poisson weights of mean 1 (units x resamples), by a hash of seed, resample and the unit's 64-bit hash."""

    def mixed(h: np.ndarray) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))

    own = mixed(np.arange(times, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    u = (mixed(unit.view(np.uint64)[:, None] ^ own[None, :]) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(_STEPS, u, side="right").astype(np.int8)


def resampled(df: DataFrame, unit: list[str], sums: dict[str, Column], times: int, seed: int) -> DataFrame:
    """(i, each name): the sums of a table in each of ``times`` resamples, weighted by unit.

    Rows of equal ``unit`` columns share a weight, so the unit may be a cell, a block, a fold in a block or a segment;
    the rows need not be grouped. A task gives one row of sums a resample. Null values count as 0.
    """
    names = list(sums)
    rows = df.select(F.xxhash64(*unit).alias("_unit"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in sums.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((times, len(names)))
        for batch in batches:
            unit = batch.column(0).to_numpy()
            values = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))], 1)
            for lo in range(0, len(unit), 1024):
                total += weights(unit[lo : lo + 1024], times, seed).T.astype(float) @ values[lo : lo + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), *(pa.array(total[:, k]) for k in range(len(names)))], ["i", *names])

    parts = rows.mapInArrow(run, ", ".join(["i bigint", *(f"`{k}` double" for k in names)]))
    return parts.groupBy("i").agg(*[F.sum(k).alias(k) for k in names])


def interval(resamples: DataFrame, statistic: Column, level: float = 0.95) -> DataFrame:
    """One row (lo, hi, positive, used): the interval of a statistic of the sums, and the share of resamples above 0.

    Resamples whose statistic is null or NaN (an empty denominator) do not count.
    """
    s = resamples.select(F.nanvl(statistic.cast("double"), F.lit(None)).alias("s")).where("s is not null")
    tail = (1 - level) / 2
    return s.agg(F.percentile("s", tail).alias("lo"), F.percentile("s", 1 - tail).alias("hi"), F.avg((F.col("s") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("used"))


def ratio_interval(df: DataFrame, unit: list[str], top: Column, bottom: Column, times: int, seed: int) -> DataFrame:
    """Interval of a ratio of sums: a mean (bottom 1), or a pooled score."""
    return interval(resampled(df, unit, {"a": top, "b": bottom}, times, seed), F.col("a") / F.nullif("b", F.lit(0.0)))


def paired_interval(df: DataFrame, unit: list[str], first: tuple[Column, Column], second: tuple[Column, Column], times: int, seed: int) -> DataFrame:
    """Interval of the difference of two arms' ratios over the same units: each resample weighs both arms alike."""
    sums = dict(zip(("a", "b", "c", "d"), (*first, *second), strict=True))
    ratio = lambda x, y: F.col(x) / F.nullif(y, F.lit(0.0))
    return interval(resampled(df, unit, sums, times, seed), ratio("a", "b") - ratio("c", "d"))


def slope_interval(df: DataFrame, unit: list[str], x: str, y: str, times: int, seed: int) -> DataFrame:
    """(slope, lo, hi, positive, used) of a least-squares line: residuals are weighted anew, x stays as it is."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    line = both.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) * F.count(F.lit(1))).alias("_xx"), F.regr_slope(y, x).alias("_b"))
    left = both.join(F.broadcast(line), F.lit(True))
    dx = F.col(x) - F.col("_mx")
    moved = resampled(left, unit, {"e": dx * (F.col(y) - F.col("_my") - F.col("_b") * dx)}, times, seed)
    out = interval(moved.join(F.broadcast(line), F.lit(True)), F.col("_b") + F.col("e") / F.nullif("_xx", F.lit(0.0)))
    return line.select(F.col("_b").alias("slope")).join(out, F.lit(True))
