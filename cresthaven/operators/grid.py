"""From points to cells: validity, extent, binning, per-cell aggregates and the 2 x 2 combination.

A half cell has the side ``res / 2``; row 0 is the northern edge.  Missing heights are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, PAD = -1e6, 2.0


def valid(points: DataFrame) -> DataFrame:
    """Points with finite coordinates above the lowest height."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("x", "y", "z")]
    return points.where(finite[0] & finite[1] & finite[2] & (F.col("z") > LOWEST))


def centre(row: Column, col: Column, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """x and y of a cell's centre."""
    return F.lit(xmin) + (col + 0.5) * res, F.lit(ymax) - (row + 0.5) * res


def extent(points: DataFrame, res: float, pad: float = PAD) -> DataFrame:
    """One row: xmin, ymax of the padded extent and the half cells' nx, ny."""
    e = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where(F.col("x0").isNotNull())
    size = lambda a, b: F.ceil(((F.col(b) + pad) - (F.col(a) - pad)) / (res / 2)).cast("int")
    return e.select((F.col("x0") - pad).alias("xmin"), (F.col("y1") + pad).alias("ymax"), size("x0", "x1").alias("nx"), size("y0", "y1").alias("ny"))


def binned(points: DataFrame, meta: DataFrame, res: float) -> DataFrame:
    """Points with their half cell and the half cells' nx, ny; points outside are dropped.

    The extent (one row) is read first and stands in the plan as literals: no join, and the bounds are plain filters.
    """
    m = meta.first()
    xmin, ymax, nx, ny = (F.lit(v) for v in m) if m else (F.lit(None).cast(t) for t in ("double", "double", "int", "int"))
    col = F.floor((F.col("x") - xmin) / (res / 2)).cast("int")
    row = F.floor((ymax - F.col("y")) / (res / 2)).cast("int")
    b = points.withColumns({"row": row, "col": col, "nx": nx, "ny": ny})
    return b.where("row >= 0 and row < ny and col >= 0 and col < nx")


def half_cells(points: DataFrame, meta: DataFrame, res: float, colour: bool = False) -> DataFrame:
    """(row, col, z, cnt[, red, green, blue sums], nx, ny): one partial and final hash aggregation."""
    more = [F.sum(F.coalesce(c, F.lit(0))).cast("double").alias(c) for c in ("red", "green", "blue")] if colour else []
    return binned(points, meta, res).groupBy("row", "col").agg(F.max("z").alias("z"), F.count("*").alias("cnt"), F.first("nx").alias("nx"), F.first("ny").alias("ny"), *more)


def blocks(half: DataFrame, colour: bool = False, compat: bool = False) -> DataFrame:
    """Half cells -> cells: median height, summed count, mean colour; an odd last half row or column is dropped.

    Colour is the mean over the points of the block; with ``compat`` it is the plain mean of the four half cells' means,
    empty ones as 0.
    """
    inside = half.where("row < (ny div 2) * 2 and col < (nx div 2) * 2")
    if not colour:
        more = []
    elif compat:
        more = [(F.sum(F.col(c) / F.col("cnt")) / 4).alias(c) for c in ("red", "green", "blue")]
    else:
        more = [(F.sum(c) / F.sum("cnt")).alias(c) for c in ("red", "green", "blue")]
    return inside.groupBy((F.floor(F.col("row") / 2)).cast("int").alias("row"), (F.floor(F.col("col") / 2)).cast("int").alias("col")).agg(F.median("z").alias("z"), F.sum("cnt").alias("cnt"), *more)


def combined(points: DataFrame, meta: DataFrame, res: float, colour: bool = False, compat: bool = False) -> DataFrame:
    """What ``blocks`` gives of ``half_cells``, in one aggregation: the four half cells of a cell are four columns of it."""
    b = binned(points, meta, res).where("row < (ny div 2) * 2 and col < (nx div 2) * 2")
    quarter = [(F.col("row") % 2 == i) & (F.col("col") % 2 == j) for i in (0, 1) for j in (0, 1)]
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = [F.max(F.when(q, F.col("z"))).alias(f"z{k}") for k, q in enumerate(quarter)] + [F.count("*").alias("cnt")]
    names = ("red", "green", "blue") if colour else ()
    if compat:
        parts += [F.sum(F.when(q, value(c))).cast("double").alias(f"{c}{k}") for c in names for k, q in enumerate(quarter)] + [F.count_if(q).alias(f"n{k}") for k, q in enumerate(quarter)]
    else:
        parts += [F.sum(value(c)).cast("double").alias(c) for c in names]
    g = b.groupBy(F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col")).agg(*parts)
    known = F.array_sort(F.array_compact(F.array(*(f"z{k}" for k in range(4)))))
    middle = F.transform(F.array(known), lambda v: (F.get(v, ((F.size(v) - 1) / 2).cast("int")) + F.get(v, (F.size(v) / 2).cast("int"))) / 2)
    if compat:
        mean = lambda c: sum((F.coalesce(F.col(f"{c}{k}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")), F.lit(0.0)) for k in range(4)), F.lit(0.0)) / 4
    else:
        mean = lambda c: F.col(c) / F.col("cnt")
    return g.select("row", "col", F.get(middle, F.lit(0)).alias("z"), "cnt", *(mean(c).alias(c) for c in names))


def build(points: DataFrame, res: float, colour: bool = False, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, meta) of a cloud; meta, a table in the driver, has the cells' nx, ny, or no row for a cloud without a valid point."""
    p = valid(points)
    m = extent(p, res).collect()  # one row
    meta = points.sparkSession.createDataFrame(m, "xmin double, ymax double, nx int, ny int")
    return combined(p, meta, res, colour, compat), meta.select("xmin", "ymax", F.expr("nx div 2").cast("int").alias("nx"), F.expr("ny div 2").cast("int").alias("ny"))
