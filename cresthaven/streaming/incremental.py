"""Cells of a growing cloud, by Structured Streaming (an extension: batch runs do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid


def running_cells(points: DataFrame, xmin: float, ymax: float, res: float) -> DataFrame:
    """A stream of points -> half cells with greatest height and count so far; write it in update mode.

    Maximum and count merge, so late points need no watermark; the 2 x 2 median is a query on the sink's latest rows.
    """
    p = grid.valid(points)
    col, row = F.floor((F.col("x") - xmin) / (res / 2)).cast("int"), F.floor((F.lit(ymax) - F.col("y")) / (res / 2)).cast("int")
    return p.groupBy(row.alias("row"), col.alias("col")).agg(F.max("z").alias("z"), F.count("*").alias("cnt"))
