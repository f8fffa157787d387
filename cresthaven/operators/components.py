"""Connected components of cell masks, over runs of cells instead of cells."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .raster import CELL


def shared(spark: SparkSession) -> str:
    """The context's checkpoint folder in the shared one that spark.checkpoint.dir names; only a local session may do without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cresthaven-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: lineage ends, lost executors do not matter."""
    shared(df.sparkSession)
    return df.checkpoint()


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """(a, b) -> (node, root), root the least node reachable: alternate linking larger and smaller neighbours to the least one until nothing changes."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a != b").distinct())
        digest = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if digest == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = digest
    raise RuntimeError("components did not settle")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key) with its place, from 1, in the order of distinct keys: ranges of the keys are numbered by themselves, and start where the ranges before end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.select(key).repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    per = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = per.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_place")).cast("int").alias(name))


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs of a mask: run (id from the first cell), row, c0, c1."""
    w = Window.partitionBy("row").orderBy("col")
    r = mask.select(*CELL, (F.col("col") - F.row_number().over(w)).alias("g"))
    r = r.groupBy("row", "g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    return r.select((F.col("row").cast("bigint") * (1 << 31) + F.col("c0")).alias("run"), "row", "c0", "c1")


def labels(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(row, col) -> (row, col, label): 8-connected (or 4-connected) components, numbered from 1 in the order of their first run.

    Touching runs of adjacent rows are found by an equi join on row and 64-column bucket, not by comparing all runs.
    """
    r = cut(runs(mask))
    reach = 1 if diagonal else 0
    spread = r.select("run", "row", "c0", "c1", F.explode(F.sequence(F.floor((F.col("c0") - reach) / 64), F.floor((F.col("c1") + reach) / 64))).alias("bucket"))
    upper = spread.select(F.col("run").alias("a"), (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), "bucket")
    lower = spread.select(F.col("run").alias("b"), "row", F.col("c0").alias("b0"), F.col("c1").alias("b1"), "bucket")
    edges = upper.join(lower, ["row", "bucket"]).where((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)).select("a", "b").distinct()
    roots = connected(edges)
    named = r.join(roots, r.run == roots.node, "left").select("row", "c0", "c1", F.coalesce("root", "run").alias("root"))
    return named.join(numbered(named.select("root").distinct(), "root", "label"), "root").select("row", F.explode(F.sequence("c0", "c1")).alias("col"), "label")


def areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("area"))


def boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def remove_small(mask: DataFrame, least: int) -> DataFrame:
    """The mask without 4-connected components of fewer than ``least`` cells."""
    l = labels(mask, diagonal=False)
    return l.join(areas(l).where(F.col("area") >= least).select("label"), "label", "left_semi").select(CELL)
