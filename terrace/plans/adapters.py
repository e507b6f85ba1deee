"""Relations of the engine made from the driver's tables, on an integer lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.native import env_of_box


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contours(spark: SparkSession, d: str) -> DataFrame:
    """Boxes: project, id, layer, env."""
    k = F.col("s_suppkey")
    x, y = k * 37 % 1000, k * 91 % 1000
    return read(spark, d, "supplier").select(F.lit(0).alias("project"), k.alias("id"), F.col("s_nationkey").alias("layer"), env_of_box(x, y, x + 20 + k % 60, y + 20 + k % 45).alias("env"))


CONTOURS = """(SELECT 0 AS project, s_suppkey AS id, s_nationkey AS layer, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x0, CAST((s_suppkey * 91) % 1000 AS DOUBLE) AS y0,
  CAST((s_suppkey * 37) % 1000 + 20 + s_suppkey % 60 AS DOUBLE) AS x1, CAST((s_suppkey * 91) % 1000 + 20 + s_suppkey % 45 AS DOUBLE) AS y1 FROM supplier)"""


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Boxes inside each other, one project per stack: project, id, size, env. A size of 50 has no area, and no contour."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = k % 40
    return read(spark, d, "part").filter(s < 50).select(p.alias("project"), k.alias("id"), s.alias("size"), env_of_box(p * 100 + s, s, p * 100 + 100 - s, 200 - s).alias("env"))


NESTED = """(SELECT p_partkey % 40 AS project, p_partkey AS id, p_size AS size, CAST((p_partkey % 40) * 100 + p_size AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0,
  CAST((p_partkey % 40) * 100 + 100 - p_size AS DOUBLE) AS x1, CAST(200 - p_size AS DOUBLE) AS y1 FROM part WHERE p_size < 50)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, d, "events").select(
        F.lit(0).alias("project"), k.alias("point"), (k * 7919 % 1100).cast("double").alias("x"), (k * 6101 % 1100).cast("double").alias("y"), F.col("value").alias("z"), F.col("event_type").alias("layer")
    )


POINTS = """(SELECT 0 AS project, event_id AS point, CAST((event_id * 7919) % 1100 AS DOUBLE) AS x, CAST((event_id * 6101) % 1100 AS DOUBLE) AS y, value AS z, event_type AS layer FROM events)"""


def pieces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(F.col("p_brand").alias("project"), k.alias("id"), (F.col("p_size") + 10).cast("double").alias("w"), (k % 30 + 5).cast("double").alias("h"))


PIECES = """(SELECT p_brand AS project, p_partkey AS id, CAST(p_size + 10 AS DOUBLE) AS w, CAST(p_partkey % 30 + 5 AS DOUBLE) AS h FROM part)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Axis-parallel segments: id, layer, x0, y0, x1, y1."""
    k, s = F.col("p_partkey"), F.col("p_size")
    flat = k % 2 == 0
    x, y = k * 13 % 400, k * 7 % 60
    dbl = lambda c: c.cast("double")
    return read(spark, d, "part").select(
        k.alias("id"), F.when(k % 3 == 0, "cut").otherwise("engrave").alias("layer"), dbl(x).alias("x0"), dbl(y).alias("y0"),
        dbl(F.when(flat, x + 5 + s).otherwise(x)).alias("x1"), dbl(F.when(flat, y).otherwise(y + 5 + s)).alias("y1"),
    )


SEGMENTS = """(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'cut' ELSE 'engrave' END AS layer, CAST((p_partkey * 13) % 400 AS DOUBLE) AS x0, CAST((p_partkey * 7) % 60 AS DOUBLE) AS y0,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 13) % 400 + 5 + p_size ELSE (p_partkey * 13) % 400 END AS DOUBLE) AS x1,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 7) % 60 ELSE (p_partkey * 7) % 60 + 5 + p_size END AS DOUBLE) AS y1 FROM part)"""
