"""Cells, masks, sites and polylines out of the star-schema tables.

The tables have no rasters, so queries start from one deterministic gridding: r = part key modulo H,
c = order key modulo W. Aggregates that do not depend on the order of addition (max, count) make the bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

H = W = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, h: int = H, w: int = W) -> DataFrame:
    """(r, c, flag, v, q, disc, tax, n), one row per occupied cell."""
    place = [(F.col("l_partkey") % h).cast("int").alias("r"), (F.col("l_orderkey") % w).cast("int").alias("c")]
    return table(spark, sf_dir, "lineitem").groupBy(*place).agg(F.max("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("v"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"), F.count(F.lit(1)).alias("n"))


def mask(cells: DataFrame, condition: str) -> DataFrame:
    return cells.where(condition).select("r", "c")


def sites(spark: SparkSession, sf_dir: str, h: int = H, w: int = W) -> DataFrame:
    """Customers as sites (id, r, c, temp, kind)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7 % h).cast("int").alias("r"), (k * 13 % w).cast("int").alias("c"), F.col("c_acctbal").alias("temp"), F.col("c_mktsegment").alias("kind"))


def vertices(spark: SparkSession, sf_dir: str, h: int = H, w: int = W) -> DataFrame:
    """Orders as vertices of a polyline per customer (line, seq, r, c)."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 3 % h).cast("int").alias("r"), (F.col("o_orderkey") * 5 % w).cast("int").alias("c"), "o_orderdate")
    return o.withColumn("seq", F.row_number().over(Window.partitionBy("line").orderBy("o_orderdate", "k"))).select("line", "seq", "r", "c")
