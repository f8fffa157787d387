"""Least-cost paths over cell windows."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA = 25.0
PATH = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))
MOVES = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def windows(candidates: DataFrame, cells: DataFrame, pad: Column, tile: int = 16) -> DataFrame:
    """Each candidate (cid, r0, c0, r1, c1, ...) with the cells of its window: the box of its ends, ``pad`` cells wider.

    An equi join on square tiles, then the exact box: neither a cross join nor a broadcast of either side.
    """
    lo = lambda a, b: F.least(a, b) - pad
    hi = lambda a, b: F.greatest(a, b) + pad
    w = candidates.withColumns({"w0": lo("r0", "r1"), "w1": hi("r0", "r1"), "v0": lo("c0", "c1"), "v1": hi("c0", "c1")})
    w = w.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("w0") / tile), F.floor(F.col("w1") / tile)))).withColumn("_tc", F.explode(F.sequence(F.floor(F.col("v0") / tile), F.floor(F.col("v1") / tile))))
    g = cells.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    return w.join(g, ["_tr", "_tc"]).where(F.col("row").between(F.col("w0"), F.col("w1")) & F.col("col").between(F.col("v0"), F.col("v1"))).drop("_tr", "_tc", "w0", "w1", "v0", "v1")


def dijkstra(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[list[tuple[int, int]], float] | None:
    """The cheapest 8-connected path: a step costs its length times the mean of both cells' costs; ties: the lesser (row, col)."""
    rows, cols = cost.shape
    best = np.full(cost.shape, np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    best[start] = 0.0
    heap = [(0.0, start)]
    values = cost.tolist()
    done = np.zeros(cost.shape, bool)
    while heap:
        d, cell = heapq.heappop(heap)
        if done[cell]:
            continue
        done[cell] = True
        if cell == end:
            path = [cell]
            while cell != start:
                cell = back[cell]
                path.append(cell)
            return path[::-1], d
        r, c = cell
        here = values[r][c]
        for dr, dc in MOVES:
            i, j = r + dr, c + dc
            if 0 <= i < rows and 0 <= j < cols and not done[i, j]:
                step = d + (1.4142135623730951 if dr and dc else 1.0) * (here + values[i][j]) / 2
                if step < best[i, j]:
                    best[i, j] = step
                    back[i, j] = cell
                    heapq.heappush(heap, (step, (i, j)))
    return None


def route(costed: DataFrame) -> DataFrame:
    """(cid, r0, c0, r1, c1, row, col, cost) -> cid, path_cost, n, path (array of row, col); a candidate's window is whole in one task.

    Cells that are missing in the window cost ``NO_DATA``.
    """
    def one(g: dict, s: int, e: int):
        r, c, cost_ = g["row"][s:e], g["col"][s:e], g["cost"][s:e]
        ends = [(int(g["r0"][s]), int(g["c0"][s])), (int(g["r1"][s]), int(g["c1"][s]))]
        top, left = min(r.min(), ends[0][0], ends[1][0]), min(c.min(), ends[0][1], ends[1][1])
        cost = np.full((max(r.max(), ends[0][0], ends[1][0]) - top + 1, max(c.max(), ends[0][1], ends[1][1]) - left + 1), NO_DATA)
        cost[r - top, c - left] = np.where(np.isnan(cost_), NO_DATA, cost_)
        found = dijkstra(cost, *[(a - top, b - left) for a, b in ends])
        return found and ([{"row": int(a + top), "col": int(b + left)} for a, b in found[0]], found[1])

    def run(batches):
        held = None
        for batch in _and_last(batches):
            if batch is not None and not batch.num_rows:
                continue
            now = [b for b in (held, batch) if b is not None]
            if not now:
                return
            t = pa.Table.from_batches(now).combine_chunks()
            g = {n: t[n].to_numpy() for n in t.column_names}
            edges = np.flatnonzero(np.append(True, g["cid"][1:] != g["cid"][:-1])).tolist()
            if batch is None:
                edges.append(len(t))
                held = None
            else:  # the last window may go on in the next batch
                held = t.slice(edges[-1]).to_batches()[0]
            out = [(int(g["cid"][s]), *found) for s, e in zip(edges[:-1], edges[1:]) if (found := one(g, s, e))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[2] for o in out], pa.float64()), pa.array([len(o[1]) for o in out], pa.int32()), pa.array([o[1] for o in out], PATH)], names=["cid", "path_cost", "n", "path"])

    rows = costed.select("cid", *(F.col(c).cast("int") for c in ("r0", "c0", "r1", "c1", "row", "col")), F.col("cost").cast("double"))
    return rows.repartition("cid").sortWithinPartitions("cid").mapInArrow(run, "cid bigint, path_cost double, n int, path array<struct<row:int,col:int>>")


def _and_last(batches):
    """The batches, then None."""
    yield from batches
    yield None
