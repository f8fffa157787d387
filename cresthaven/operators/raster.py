"""Neighbourhood operators on cells (row, col, value).

Each operator scatters a cell's value to the cells that look at it and gathers by (row, col): one shuffle whatever
the number of neighbours, instead of a join for each.  Cells that are not there are NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["row", "col"]
COMPASS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def disk(radius: float) -> list[tuple[int, int]]:
    k = int(radius)
    return [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1) if r * r + c * c <= radius * radius]


def offsets(pairs, name: str = "o") -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in pairs])).alias(name)


def scatter(cells: DataFrame, pairs, *columns: str) -> DataFrame:
    """A row for each cell and offset, at the cell that sees it under that offset: (row, col, dr, dc, columns)."""
    e = cells.select(*CELL, *columns, offsets(pairs))
    return e.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *columns)


def at(dr: int, dc: int, value: str = "z") -> Column:
    return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col(value)))


def here() -> Column:
    return F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.lit(True)))


def shift(cells: DataFrame, dr: int, dc: int) -> DataFrame:
    """Each cell with the value at (row + dr, col + dc), NULL off the grid."""
    s = scatter(cells, {(0, 0), (dr, dc)}, "z")
    return s.groupBy(CELL).agg(here().alias("own"), at(dr, dc).alias("z")).where("own").drop("own")


def on_grid(cells: DataFrame, nx: int | None, ny: int | None) -> DataFrame:
    return cells if nx is None else cells.where((F.col("row") >= 0) & (F.col("row") < ny) & (F.col("col") >= 0) & (F.col("col") < nx))


def dilate(mask: DataFrame, pairs, nx: int | None = None, ny: int | None = None) -> DataFrame:
    """Cells with a set neighbour under the kernel; with nx and ny those of the grid only."""
    return on_grid(scatter(mask, pairs).select(CELL).distinct(), nx, ny)


def erode(mask: DataFrame, pairs, nx: int | None = None, ny: int | None = None) -> DataFrame:
    """Cells all of whose neighbours under the kernel are set; off the grid counts as not set, with nx and ny as set."""
    n = F.count("*")
    if nx is not None:
        outside = lambda r, c: (F.col("row") + r < 0) | (F.col("row") + r >= ny) | (F.col("col") + c < 0) | (F.col("col") + c >= nx)
        beyond = sum((F.when(outside(r, c), 1).otherwise(0) for r, c in pairs), F.lit(0))
        return on_grid(scatter(mask, pairs).groupBy(CELL).agg(n.alias("n")).where(F.col("n") + beyond == len(pairs)).select(CELL), nx, ny)
    return scatter(mask, pairs).groupBy(CELL).agg(n.alias("n")).where(F.col("n") == len(pairs)).select(CELL)


def opening(mask: DataFrame, pairs, nx: int | None = None, ny: int | None = None) -> DataFrame:
    return dilate(erode(mask, pairs, nx, ny), pairs, nx, ny)


def closing(mask: DataFrame, pairs, nx: int | None = None, ny: int | None = None) -> DataFrame:
    return erode(dilate(mask, pairs, nx, ny), pairs, nx, ny)


def border(cells: DataFrame) -> DataFrame:
    """Valued cells beside a cell without a value: the nearest valued cell of any other cell is one of them."""
    s = scatter(cells.where("z is not null"), [(0, 0), *COMPASS], "z")
    return s.groupBy(CELL).agg(F.count("*").alias("n"), here().alias("own"), at(0, 0).alias("z")).where("own and n < 9").select(*CELL, "z")


def fill(cells: DataFrame, radius: float) -> DataFrame:
    """Every cell within ``radius`` of a valued one: the nearest value (ties: the least row, col) and its squared distance.

    Only border cells are scattered, so the work follows the length of the edges of holes, not the whole area.
    """
    s = scatter(border(cells), [p for p in disk(radius) if p != (0, 0)], "z")
    source = [F.col("row") + F.col("dr"), F.col("col") + F.col("dc")]
    s = s.select(*CELL, "z", (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), source[0].alias("sr"), source[1].alias("sc"))
    own = cells.where("z is not null").select(*CELL, "z", F.lit(0).alias("d2"), F.col("row").alias("sr"), F.col("col").alias("sc"))
    return own.unionByName(s).groupBy(CELL).agg(F.min_by("z", F.struct("d2", "sr", "sc")).alias("z"), F.min("d2").alias("d2"))


def region(cells: DataFrame, radius: float = 3.0) -> DataFrame:
    """Cells within ``radius`` cells of a valued one."""
    return fill(cells, radius).select(CELL)


def median3(cells: DataFrame) -> DataFrame:
    """The median of the 3 x 3 neighbourhood, the edge of the grid (columns nx, ny) repeated; for the cells that are there."""
    def seen_from(x: str, n: str) -> Column:
        # the rows (or columns) that look at this one; those on the edge do so once more, for what lies beyond
        c, none = F.col(x), F.array().cast("array<int>")
        return F.concat(F.array(c - 1, c, c + 1), F.when(c == 0, F.array(c)).otherwise(none), F.when(c == F.col(n) - 1, F.array(c)).otherwise(none))

    s = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "z", "nx", "ny", seen_from("row", "ny").alias("rows"), seen_from("col", "nx").alias("cols"))
    s = s.select("r", "c", "z", "cols", F.explode("rows").alias("row")).select("r", "c", "z", "row", F.explode("cols").alias("col"))
    own = F.bool_or((F.col("r") == F.col("row")) & (F.col("c") == F.col("col")))
    return s.groupBy(CELL).agg(own.alias("own"), F.median("z").alias("z")).where("own").drop("own")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    k = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return [x / sum(w) for x in w]


def gaussian(cells: DataFrame, sigma: float = 1.0, nx: int | None = None, ny: int | None = None) -> DataFrame:
    """Separable Gaussian smoothing over the cells that are there (weights renormalised where some are missing).

    With nx and ny what lies beyond the edges of the grid is its mirror image, the edge cells repeated; without them it
    is missing.
    """
    w = gaussian_weights(sigma)
    k = len(w) // 2
    weights = F.array(*map(F.lit, w))
    out = cells.where("z is not null").select(*CELL, "z")
    for axis, size in (("row", ny), ("col", nx)):
        other = "col" if axis == "row" else "row"
        images = F.array(F.col(axis))
        if size is not None:
            none = F.array().cast("array<int>")
            images = F.concat(images, F.when(F.col(axis) < k, F.array(-1 - F.col(axis))).otherwise(none), F.when(F.col(axis) >= size - k, F.array(2 * size - 1 - F.col(axis))).otherwise(none))
        s = out.select(other, "z", F.col(axis).alias("at"), F.explode(images).alias("image")).select(other, "z", "at", "image", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("o"))
        s = s.select(other, "z", (F.col("image") + F.col("o")).alias(axis), F.col("at"), F.element_at(weights, F.col("o") + k + 1).alias("w"))
        out = s.groupBy(CELL).agg(F.bool_or(F.col("at") == F.col(axis)).alias("own"), (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z")).where("own").select(*CELL, "z")
    return out


def slope(cells: DataFrame, res: float) -> DataFrame:
    """(row, col, z, slope): degrees of the central-difference gradient; one-sided at the edges nx, ny of the grid (columns of ``cells``), NULL beside missing cells."""
    s = scatter(cells, [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)], "z", "nx", "ny")
    g = s.groupBy(CELL).agg(here().alias("own"), at(0, 0).alias("z"), at(-1, 0).alias("up"), at(1, 0).alias("down"), at(0, -1).alias("left"), at(0, 1).alias("right"), F.max("nx").alias("nx"), F.max("ny").alias("ny")).where("own")
    along = lambda at_, n, a, b: F.when(F.col(at_) == 0, (F.col(b) - F.col("z")) / res).when(F.col(at_) == F.col(n) - 1, (F.col("z") - F.col(a)) / res).otherwise((F.col(b) - F.col(a)) / (2 * res))
    gx, gy = along("col", "nx", "left", "right"), along("row", "ny", "up", "down")
    return g.select(*CELL, "z", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope"))


def distance(mask: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """Exact squared Euclidean distance, in cells, from each of ``cells`` to the nearest of ``mask``, separably.

    Along rows the nearest set cell of each column is found by windows, then the least sum over columns within
    ``reach`` is taken; cells with none within ``reach`` are NULL.  With reach as large as the grid is wide it is
    the unbounded transform.
    """
    every = cells.select(*CELL, F.lit(0).alias("set")).unionByName(mask.select(*CELL, F.lit(1).alias("set"))).groupBy(CELL).agg(F.max("set").alias("set"))
    up = Window.partitionBy("col").orderBy("row")
    down = Window.partitionBy("col").orderBy(F.desc("row"))
    marked = F.when(F.col("set") == 1, F.col("row"))
    near = every.select(*CELL, F.least(F.abs(F.col("row") - F.last(marked, True).over(up)), F.abs(F.col("row") - F.last(marked, True).over(down))).alias("d"))
    seen = scatter(near, [(0, c) for c in range(-reach, reach + 1)], "d")
    best = seen.groupBy(CELL).agg(here().alias("own"), F.min(F.col("d") * F.col("d") + F.col("dc") * F.col("dc")).alias("d2")).where("own")
    return best.select(*CELL, F.when(F.col("d2") <= reach * reach, F.col("d2")).alias("d2"))


def nearest(points: DataFrame, nx: int, ny: int, kind: str = "kind") -> DataFrame:
    """(kind, row, col) -> for every kind and every cell of the ny x nx grid the nearest point of the kind, however far: (kind, row, col, d2, sr, sc).

    Exact and separable: windows give each column's nearest point, then every row is swept once (lower envelope of
    parabolas).  Ties: the least row, col.  Points off the grid do not count; a kind without points has no cells.  A task holds a row of the grid.
    """
    points = points.where((F.col("row") >= 0) & (F.col("row") < ny) & (F.col("col") >= 0) & (F.col("col") < nx))
    at_rows, at_cols = F.sequence(F.lit(0), F.lit(ny - 1)), F.sequence(F.lit(0), F.lit(nx - 1))
    grid = points.select(F.col(kind).alias("kind")).distinct().select("kind", F.explode(at_rows).alias("row")).select("kind", "row", F.explode(at_cols).alias("col"))
    there = points.select(F.col(kind).alias("kind"), *CELL, F.col("row").alias("at")).distinct()
    every = grid.join(there, ["kind", *CELL], "left")
    w = Window.partitionBy("kind", "col")
    up, down = F.last("at", True).over(w.orderBy("row")), F.last("at", True).over(w.orderBy(F.desc("row")))
    every = every.select("kind", *CELL, up.alias("up"), down.alias("down"))
    first = F.col("down").isNull() | (F.col("row") - F.col("up") <= F.col("down") - F.col("row"))
    every = every.select("kind", *CELL, F.when(F.col("up").isNotNull() & first, F.col("up")).otherwise(F.col("down")).cast("double").alias("sr"))
    big = nx * ny  # d2 * big + place of the point orders by distance, then row, col

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("col")
        row, places, cols = int(g["row"].iloc[0]), g["sr"].tolist(), g["col"].tolist()
        best: list[tuple[int, int, int]] = []  # from which column on, column, constant of its parabola
        for q, sr in zip(cols, places):
            if math.isnan(sr):
                continue
            c = (row - int(sr)) ** 2 * big + int(sr) * nx + q
            start = 0
            while best:
                since, v, b = best[-1]
                start = ((c + big * q * q) - (b + big * v * v)) // (2 * big * (q - v)) + 1
                if start > since:
                    break
                best.pop()
                start = 0
            if start < nx:
                best.append((start, q, c))
        k, source = 0, []
        for i in cols:
            while k + 1 < len(best) and best[k + 1][0] <= i:
                k += 1
            source.append(best[k][1])
        sc = np.array(source)
        sr = g["sr"].to_numpy()[sc].astype("int64")
        col = g["col"].to_numpy()
        return pd.DataFrame({"kind": g["kind"].to_numpy(), "row": row, "col": col, "d2": (sr - row) ** 2 + (sc - col) ** 2, "sr": sr, "sc": sc})

    return every.groupBy("kind", "row").applyInPandas(one, f"kind {dict(points.dtypes)[kind]}, row int, col int, d2 bigint, sr int, sc int")


def boundary(labels: DataFrame) -> DataFrame:
    """Cells of a component (row, col, label) with at least one of the eight neighbours outside it."""
    s = scatter(labels, [(0, 0), *COMPASS], "label")
    return s.groupBy(*CELL, "label").agg(F.count("*").alias("n"), here().alias("own")).where("own and n < 9").select(*CELL, "label")


def ray_cells(rays_m, res: float, distinct: bool) -> list[int]:
    steps = [max(1, round(m / res)) for m in rays_m]
    return sorted(set(steps)) if distinct else steps


def ray_edges(labels: DataFrame, cells: DataFrame, rays_m=(2.0, 3.0, 4.0, 5.0), res: float = 1.0, drop: float = 1.0, boxed: bool = False) -> DataFrame:
    """Crest and toe flags of boundary cells: in some direction the mean height outside the component is lower (crest) or higher (toe) by over ``drop``.

    boxed: rays see only the cells of the component's bounding box.
    """
    rays = ray_cells(rays_m, res, False)
    need = max(1, len(rays) // 2)
    both = cells.select(*CELL, "z").join(labels, CELL, "left")
    edge = boundary(labels).join(cells.select(*CELL, "z"), CELL)
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(r * k).alias("dr"), F.lit(c * k).alias("dc")) for i, (r, c) in enumerate(COMPASS) for k in rays])).alias("p")
    e = edge.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("label").alias("own"), F.col("z").alias("zc"), probes)
    e = e.select("r", "c", "own", "zc", "p.dir", (F.col("r") + F.col("p.dr")).alias("row"), (F.col("c") + F.col("p.dc")).alias("col"))
    hit = e.join(both, CELL).where("z is not null and not (label <=> own)")
    if boxed:
        box = labels.groupBy(F.col("label").alias("own")).agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
        hit = hit.join(box, "own").where("row between row0 and row1 and col between col0 and col1")
    per = hit.groupBy("r", "c", "own", "zc", "dir").agg(F.avg("z").alias("out"), F.count("*").alias("n")).where(F.col("n") >= need)
    flags = per.groupBy(F.col("r").alias("row"), F.col("c").alias("col"), F.col("own").alias("label")).agg(F.bool_or(F.col("zc") - F.col("out") > drop).alias("crest"), F.bool_or(F.col("out") - F.col("zc") > drop).alias("toe"))
    return flags.where("crest or toe")


def step_edges(sloped: DataFrame, rays_m=(2.0, 3.0, 4.0, 5.0), res: float = 1.0, drop: float = 1.0, centre_slope: float = 25.0) -> DataFrame:
    """(row, col, z, slope) -> cells that are crest or toe by votes of rays: enough rays of one direction drop (or rise) by over ``drop``; of both the larger mean wins, crest on a tie."""
    rays = ray_cells(rays_m, res, True)
    need = max(2, math.ceil(0.6 * len(rays)))
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(r * k).alias("dr"), F.lit(c * k).alias("dc")) for i, (r, c) in enumerate(COMPASS) for k in rays])).alias("p")
    centre = sloped.where(F.col("z").isNotNull() & (F.col("slope") <= centre_slope))
    e = centre.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("z").alias("zc"), probes)
    e = e.select("r", "c", "zc", "p.dir", (F.col("r") + F.col("p.dr")).alias("row"), (F.col("c") + F.col("p.dc")).alias("col"))
    hit = e.join(sloped.where("z is not null").select(*CELL, "z"), CELL).withColumn("fall", F.col("zc") - F.col("z"))
    per = hit.groupBy("r", "c", "dir").agg(F.count_if(F.col("fall") > drop).alias("down"), F.avg(F.when(F.col("fall") > drop, F.col("fall"))).alias("mean_down"), F.count_if(F.col("fall") < -drop).alias("up"), F.avg(F.when(F.col("fall") < -drop, -F.col("fall"))).alias("mean_up"))
    best = per.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max("down").alias("down"), F.coalesce(F.max("mean_down"), F.lit(0.0)).alias("mean_down"), F.max("up").alias("up"), F.coalesce(F.max("mean_up"), F.lit(0.0)).alias("mean_up"))
    crest, toe = F.col("down") >= need, F.col("up") >= need
    kind = F.when(crest & (~toe | (F.col("mean_down") >= F.col("mean_up"))), "crest").when(toe, "toe")
    return best.select(*CELL, kind.alias("type")).where("type is not null")


def in_rectangle(cells: DataFrame, rectangle, xmin: float, ymax: float, res: float) -> DataFrame:
    """Cells in a rectangle given by two opposite corners (x, y, x, y), as a half-open cell range."""
    xa, ya, xb, yb = rectangle
    c0, c1 = math.floor((min(xa, xb) - xmin) / res), math.ceil((max(xa, xb) - xmin) / res)
    r0, r1 = math.floor((ymax - max(ya, yb)) / res), math.ceil((ymax - min(ya, yb)) / res)
    return cells.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
