"""Volumes, trees and point sets derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v: a 64 x 64 x 32 volume from lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("y"),
                      (F.col("l_orderkey") % 32).cast("int").alias("z")).agg(F.max(F.col("l_quantity").cast("int")).alias("v"))


def mask(spark: SparkSession, sf_dir: str, t: int = 45) -> DataFrame:
    return image(spark, sf_dir).where(F.col("v") > t).select("x", "y", "z")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, x, y, z, radius, parent (null at the root): one tree over part."""
    i = F.col("p_partkey") + 1
    parent = F.when(i == 1, F.lit(None)).when(i % 5 == 0, F.floor(i / 5)).otherwise(i - 1).cast("long")
    return read(spark, sf_dir, "part").select(
        i.alias("id"), F.when(i == 1, 1).otherwise(3).alias("type"), (i * 37 % 101).cast("double").alias("x"), (i * 53 % 103).cast("double").alias("y"),
        (i * 71 % 107).cast("double").alias("z"), ((F.col("p_size") % 7 + 1) * F.lit(0.5)).alias("radius"), parent.alias("parent"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("seed_id"), (k * 7 % 64).cast("int").alias("x"), (k * 11 % 64).cast("int").alias("y"), (k * 13 % 32).cast("int").alias("z"), (k % 3 + 1).cast("int").alias("radius"))


def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("a"), (k * 17 % 211).alias("x"), (k * 29 % 199).alias("y"), (k * 31 % 193).alias("z"))


def auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("b"), (k * 19 % 211).alias("x"), (k * 23 % 199).alias("y"), (k * 37 % 193).alias("z"))


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "value")


IMG = """img AS (SELECT CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_suppkey % 64 AS INTEGER) AS y,
  CAST(l_orderkey % 32 AS INTEGER) AS z, max(CAST(l_quantity AS INTEGER)) AS v FROM lineitem GROUP BY 1, 2, 3)"""


def mask_sql(t: int = 45, name: str = "m") -> str:
    return f"{name} AS (SELECT x, y, z FROM img WHERE v > {t})"


TREE = """t AS (SELECT p_partkey + 1 AS id, CASE WHEN p_partkey = 0 THEN 1 ELSE 3 END AS type,
  CAST((p_partkey + 1) * 37 % 101 AS DOUBLE) AS x, CAST((p_partkey + 1) * 53 % 103 AS DOUBLE) AS y, CAST((p_partkey + 1) * 71 % 107 AS DOUBLE) AS z,
  (p_size % 7 + 1) * CAST(0.5 AS DOUBLE) AS radius,
  CASE WHEN p_partkey = 0 THEN NULL WHEN (p_partkey + 1) % 5 = 0 THEN (p_partkey + 1) // 5 ELSE p_partkey END AS parent FROM part)"""
SEEDS = """s AS (SELECT s_suppkey AS seed_id, CAST(s_suppkey * 7 % 64 AS INTEGER) AS x, CAST(s_suppkey * 11 % 64 AS INTEGER) AS y,
  CAST(s_suppkey * 13 % 32 AS INTEGER) AS z, CAST(s_suppkey % 3 + 1 AS INTEGER) AS radius FROM supplier)"""
PROOF = "a AS (SELECT s_suppkey AS a, s_suppkey * 17 % 211 AS x, s_suppkey * 29 % 199 AS y, s_suppkey * 31 % 193 AS z FROM supplier)"
AUTO = "b AS (SELECT c_custkey AS b, c_custkey * 19 % 211 AS x, c_custkey * 23 % 199 AS y, c_custkey * 37 % 193 AS z FROM customer)"
#: Face neighbours and the sphere stencil, as SQL tables.
K6 = "k6(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
BOX = "r(i) AS (SELECT CAST(range - 8 AS INTEGER) FROM range(17)), box AS (SELECT p.i AS dx, q.i AS dy, w.i AS dz FROM r p, r q, r w)"
KEY = "((CAST(z AS BIGINT) + 1048576) << 42) + ((CAST(y AS BIGINT) + 1048576) << 21) + (CAST(x AS BIGINT) + 1048576)"
