"""Clouds, lines, guides and jobs as DataFrames: a synthetic terrace, and the same shapes derived from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAMPS, RISE, RAMP_WIDTH = (30.0, 75.0, 120.0), 12.0, 8.0


def terrace_height(u: Column) -> Column:
    """Three ramps of 12 m, each 8 m wide."""
    steps = [F.least(F.greatest((u - s) / RAMP_WIDTH, F.lit(0.0)), F.lit(1.0)) for s in RAMPS]
    return (steps[0] + steps[1] + steps[2]) * RISE


def terrace(spark: SparkSession, wavy: bool = False) -> DataFrame:
    """points(x, y, z, red, green, blue) of the synthetic terraces: a 450 x 300 lattice, 0.4 m apart."""
    p = spark.range(135_000).select(((F.col("id") % 450) * 0.4).alias("x"), (F.floor(F.col("id") / 450) * 0.4).alias("y"))
    if not wavy:
        z = terrace_height(F.col("x"))
    else:
        z = terrace_height(F.col("x") + 3 * F.sin(F.col("y") / 14)) + 0.025 * F.sin("x") * F.cos("y")
    p = p.withColumn("z", z)
    if wavy:
        p = p.select(*(F.col(c).cast("float").cast("double").alias(c) for c in ("x", "y", "z")))
    return p.select("x", "y", "z", F.floor(110 + 2 * F.col("z")).cast("smallint").alias("red"), F.lit(135).cast("smallint").alias("green"), F.lit(120).cast("smallint").alias("blue"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points from lineitem: places and colours from its keys, height from the terraces and the quantity."""
    t = table(spark, sf_dir, "lineitem")
    x = ((F.col("l_partkey") * 13 + F.col("l_linenumber") * 7) % 1800) / F.lit(10.0)
    y = ((F.col("l_orderkey") * 37 + F.col("l_suppkey") * 11) % 1200) / F.lit(10.0)
    p = t.select(x.alias("x"), y.alias("y"), "l_quantity", *((F.col(c) % 256).cast("int").alias(n) for c, n in (("l_partkey", "red"), ("l_suppkey", "green"), ("l_orderkey", "blue"))))
    return p.select("x", "y", (terrace_height(F.col("x")) + F.col("l_quantity") * 0.001).alias("z"), "red", "green", "blue")


def event_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertices(line_id, type, idx, x, y): a line for each user's events in order of time."""
    t = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("user_id") % 2 == 0, "crest").otherwise("toe")
    return t.select(F.col("user_id").alias("line_id"), kind.alias("type"), (F.row_number().over(w) - 1).alias("idx"), ((F.col("event_id") % 997) * 0.5).alias("x"), F.col("value").alias("y"))


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs(id, status, stage, created_at, progress) from orders."""
    t = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scene"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 101).cast("int").alias("progress"))
