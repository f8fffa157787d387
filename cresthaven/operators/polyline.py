"""Polylines as long tables: vertices (line_id, type, idx, x, y).

Segment lengths are decimals to the micrometre, so sums do not depend on the order in which they are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LENGTH = "decimal(18,6)"


def along():
    """A line's vertices in order."""
    return Window.partitionBy("line_id").orderBy("idx")


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def segments(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices: line_id, type, idx (of the first), x0, y0, x1, y1, seg, cum0, cum1 (lengths before and after)."""
    nxt = lambda c: F.lead(c).over(along())
    s = vertices.select("line_id", "type", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1")).where("x1 is not null")
    s = s.withColumn("seg", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast(LENGTH))
    s = s.withColumn("cum1", F.sum("seg").over(along().rowsBetween(Window.unboundedPreceding, 0)).cast(LENGTH))
    return s.withColumn("cum0", (F.col("cum1") - F.col("seg")).cast(LENGTH))


def lengths(vertices: DataFrame) -> DataFrame:
    """line_id, type, n (vertices), length."""
    prev = lambda c: F.lag(c).over(along())
    s = vertices.select("line_id", "type", F.coalesce(norm(F.col("x") - prev("x"), F.col("y") - prev("y")).cast(LENGTH), F.lit(0).cast(LENGTH)).alias("seg"))
    return s.groupBy("line_id", "type").agg(F.count("*").alias("n"), F.sum("seg").cast("double").alias("length"))


def cumulative(vertices: DataFrame) -> DataFrame:
    """line_id, idx, cum: length from the line's start to each vertex."""
    s = vertices.select("line_id", "idx", F.coalesce(norm(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along())).cast(LENGTH), F.lit(0).cast(LENGTH)).alias("seg"))
    return s.select("line_id", "idx", F.sum("seg").over(along().rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("cum"))


def resample(vertices: DataFrame, step: float, end: str = "always") -> DataFrame:
    """Points every ``step`` metres from the start: line_id, type, k, x, y.

    end: "always" adds the last vertex if no point is there; "reached" has a point there only at a whole number of
    steps; "never" leaves it out.  A line without length gives its first vertex.
    """
    s = segments(vertices).withColumns({"a": F.col("cum0").cast("double"), "b": F.col("cum1").cast("double")})
    s = s.withColumn("total", F.max("b").over(Window.partitionBy("line_id")))
    last = F.ceil(F.col("b") / step) - 1
    if end == "reached":
        last = F.when(F.col("b") == F.col("total"), F.floor(F.col("b") / step)).otherwise(last)
    s = s.where("seg > 0").select("*", F.ceil(F.col("a") / step).alias("k0"), last.alias("k1")).where("k0 <= k1")
    p = s.select("*", F.explode(F.sequence("k0", "k1")).alias("k")).withColumn("t", (F.col("k") * F.lit(float(step)) - F.col("a")) / F.col("seg").cast("double"))
    p = p.select("line_id", "type", "k", (F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).alias("y"))
    total = lengths(vertices)
    first = vertices.where("idx = 0").join(total.where("length = 0").select("line_id"), "line_id", "left_semi").select("line_id", "type", F.lit(0).cast("bigint").alias("k"), "x", "y")
    p = p.unionByName(first)
    if end == "always":
        finish = vertices.join(total.where("length > 0").select("line_id", F.col("n"), "length"), "line_id").where("idx = n - 1")
        p = p.unionByName(finish.select("line_id", "type", F.ceil(F.col("length") / step).alias("k"), "x", "y"))
    return p


def packed(vertices: DataFrame) -> DataFrame:
    """line_id, type, pts: array of (x, y) in order."""
    a = vertices.groupBy("line_id", "type").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    return a.select("line_id", "type", F.transform("p", lambda v: F.struct(v.x.alias("x"), v.y.alias("y"))).alias("pts"))


def unpacked(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", "type", F.posexplode("pts").alias("idx", "p")).select("line_id", "type", F.col("idx").cast("bigint").alias("idx"), "p.x", "p.y")


def deduplicate(pts: Column, tolerance: float, inclusive: bool) -> Column:
    """A fold over an array of points that keeps those farther than ``tolerance`` from the last one kept.

    inclusive: at the tolerance is far enough, and the last vertex is kept if it differs from the last kept; otherwise
    it has to be beyond, and the last vertex always stays.
    """
    far = lambda a, b: norm(a.x - b.x, a.y - b.y) >= tolerance if inclusive else norm(a.x - b.x, a.y - b.y) > tolerance
    tail = lambda acc: F.element_at(acc, -1)
    kept = F.aggregate(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1), lambda acc, p: F.when(far(tail(acc), p), F.concat(acc, F.array(p))).otherwise(acc))
    end = F.element_at(pts, -1)
    return F.transform(F.array(kept), lambda k: F.when((tail(k).x != end.x) | (tail(k).y != end.y), F.concat(k, F.array(end))).otherwise(k))[0]


def smooth3(series: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Moving mean of three, the ends repeated, in column ``smooth``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumn("smooth", (F.coalesce(F.lag(value).over(w), value) + F.col(value) + F.coalesce(F.lead(value).over(w), value)) / 3)


def local_minima(series: DataFrame, value: str, keys: list[str], order: str, most: float, eps: float = 1e-6) -> DataFrame:
    """Rows at most ``most`` that no neighbour undercuts by over ``eps``, and both ends if at most ``most``."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    s = series.withColumns({"_p": prev, "_n": nxt})
    v = F.col(value)
    return s.where((v <= most) & (F.col("_p").isNull() | F.col("_n").isNull() | ((v <= F.col("_p") + eps) & (v <= F.col("_n") + eps)))).drop("_p", "_n")


def separated(minima: DataFrame, value: str, keys: list[str], order: str, apart: int, most: int = 8) -> DataFrame:
    """Greedy by value: of each group up to ``most`` rows at least ``apart`` from one another in ``order``; (keys, order)."""
    a = minima.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(value, order))).alias("m"))
    empty = F.array().cast("array<bigint>")
    kept = F.aggregate("m", empty, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: F.abs(k - x[order]) < apart), F.concat(acc, F.array(x[order].cast("bigint")))).otherwise(acc))
    return a.select(*keys, F.explode(kept).alias(order))


def tangents(vertices: DataFrame) -> DataFrame:
    """Line ends with outward unit tangents: line_id, type, which (s or e), x, y, tx, ty.

    The tangent spans min(15, max(0.4 length, 0.1)) metres of the line; ends without direction are left out.
    """
    c = vertices.join(cumulative(vertices), ["line_id", "idx"])
    g = c.groupBy("line_id", "type").agg(F.sort_array(F.collect_list(F.struct("idx", "cum", "x", "y"))).alias("v")).where(F.size("v") > 1)
    total = F.element_at("v", -1).cum
    look = F.least(F.lit(15.0), F.greatest(total * 0.4, F.lit(0.1)))
    # places count from 0; the first vertex after the start that is at least so far along the line
    reach = lambda far: F.array_min(F.transform(F.filter(F.slice("v", 2, F.size("v") - 1), lambda p: p.cum >= far), lambda p: p.idx))
    last = F.size("v") - 1
    g = g.withColumns({"i": F.coalesce(reach(look), last).cast("int"), "j": F.greatest(F.coalesce(reach(F.greatest(total - look, F.lit(0.0))), last + 1) - 2, F.lit(0)).cast("int"), "m": last})
    side = lambda which, at, to: F.struct(F.lit(which).alias("which"), F.get("v", at).alias("p"), F.get("v", to).alias("q"))
    e = g.select("line_id", "type", F.explode(F.array(side("s", F.lit(0), F.col("i")), side("e", F.col("m"), F.col("j")))).alias("e")).select("line_id", "type", "e.*")
    e = e.withColumn("n", norm(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y"))).where("n >= 1e-6")
    return e.select("line_id", "type", "which", "p.x", "p.y", ((F.col("p.x") - F.col("q.x")) / F.col("n")).alias("tx"), ((F.col("p.y") - F.col("q.y")) / F.col("n")).alias("ty"))


def sample_tangents(samples: DataFrame, vertices: DataFrame, reach: int = 2) -> DataFrame:
    """Samples (line_id, type, k, x, y) with the line's unit direction: from two vertices before to two after the nearest vertex."""
    v = vertices.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("v"))
    s = samples.join(v, "line_id")
    near = F.array_min(F.transform("v", lambda p: F.struct(((p.x - F.col("x")) * (p.x - F.col("x")) + (p.y - F.col("y")) * (p.y - F.col("y"))).alias("d"), p.idx.alias("i"))))
    s = s.withColumn("j", near.i)
    a = F.get("v", F.greatest(F.col("j") - reach, F.lit(0)).cast("int"))
    b = F.get("v", F.least(F.col("j") + reach, F.size("v") - 1).cast("int"))
    s = s.select("line_id", "type", "k", "x", "y", (b.x - a.x).alias("dx"), (b.y - a.y).alias("dy")).withColumn("n", norm(F.col("dx"), F.col("dy"))).where("n >= 1e-6")
    return s.select("line_id", "type", "k", "x", "y", (F.col("dx") / F.col("n")).alias("tx"), (F.col("dy") / F.col("n")).alias("ty"))


def to_cells(points: DataFrame, xmin: float, ymax: float, res: float, nx: int, ny: int) -> DataFrame:
    """Add the clamped cell of each point: outside the grid the edge cell counts."""
    cell = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v.cast("int")))
    return points.withColumns({"row": cell((F.lit(ymax) - F.col("y")) / res, ny), "col": cell((F.col("x") - F.lit(xmin)) / res, nx)})


def rasterise(vertices: DataFrame, step: float, xmin: float, ymax: float, res: float, nx: int, ny: int) -> DataFrame:
    """The cells that lines pass, by type."""
    return to_cells(resample(vertices, step), xmin, ymax, res, nx, ny).select("type", "row", "col").distinct()


def nearest_on(queries: DataFrame, vertices: DataFrame, within: float | None = None) -> DataFrame:
    """queries (query_id, qx, qy, type) x lines of that type -> the nearest point of each line: query_id, line_id, distance, x, y; the first of equal ones.

    within: only lines that come so near; segments are then dealt into square buckets around their boxes, an equi join
    instead of every query meeting every segment.
    """
    if within is None:
        return nearest_lines(queries, vertices)
    s = segments(vertices)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - within) / within), F.floor((F.greatest(a, b) + within) / within))
    s = s.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1")))
    j = queries.withColumns({"_bx": F.floor(F.col("qx") / within), "_by": F.floor(F.col("qy") / within)}).join(s, ["type", "_bx", "_by"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("qx") - F.col("x0")) * dx + (F.col("qy") - F.col("y0")) * dy) / l2))).otherwise(F.lit(0.0))
    j = j.withColumns({"px": F.col("x0") + t * dx, "py": F.col("y0") + t * dy}).withColumn("d", norm(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))
    j = j.where(F.col("d") <= within)
    best = j.groupBy("query_id", "line_id").agg(F.min(F.struct(F.col("d").alias("distance"), "idx", F.col("px").alias("x"), F.col("py").alias("y"))).alias("b"))
    return best.select("query_id", "line_id", "b.distance", "b.x", "b.y")


QUERIES, SEGMENTS = 1024, 1 << 16  # queries that a part of the lines meets at once, segments of a part
NEAREST = pa.schema([("query_id", pa.int64()), ("line_id", pa.int64()), ("distance", pa.float64()), ("x", pa.float64()), ("y", pa.float64())])


def nearest_lines(queries: DataFrame, vertices: DataFrame, digits: int | None = None) -> DataFrame:
    """``nearest_on`` for every line of the type: query_id, line_id, distance, x, y, rounded to ``digits``.

    Lines are dealt into parts, and all queries of their type pass by each part in Arrow: a line is whole in its part, so its
    nearest point is found there and nothing is merged afterwards.  Only queries are copied.  Query ids are unique.
    """
    q = queries.where("type is not null and query_id is not null")
    q = q.select("type", F.col("query_id").cast("bigint").alias("id"), F.col("qx").cast("double").alias("x0"), F.col("qy").cast("double").alias("y0"))
    return passing(q, vertices).mapInArrow(lambda batches: _nearest(batches, digits), ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'double'}" for f in NEAREST))


def passing(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rows (type, part, side, id, idx, x0, y0, x1, y1, ...) sorted by type, part and side: parts of whole lines as segments (side 0), then all queries (type, id, x0, y0, ...) of their type."""
    v = vertices.where("type is not null and line_id is not null")
    n = -(-(v.groupBy("type").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) // SEGMENTS) or 1
    s = segments(v).select("type", F.pmod(F.hash("line_id"), F.lit(n)).alias("part"), F.lit(0).alias("side"), F.col("line_id").cast("bigint").alias("id"), F.col("idx").cast("bigint").alias("idx"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    q = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("side", F.lit(1))
    keys = ["type", "part"]
    parts = 4 * int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return s.unionByName(q, allowMissingColumns=True).repartition(parts, *keys).sortWithinPartitions(*keys, "side")


def met(batches, columns: list[str], at_once: int):
    """From rows of ``passing`` yield (Lines of a part, tables of up to ``at_once`` queries with ``columns``); a part's lines alone are held."""
    keys, now, rows, lines, asked, n = ["type", "part"], None, [], None, [], 0

    def table(held):
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        change = np.zeros(b.num_rows, bool)
        for c in [*keys, "side"]:
            v = b.column(c)
            change[1:] |= pa.compute.not_equal(v.slice(1), v.slice(0, max(0, len(v) - 1))).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            key = tuple(b.column(c)[s].as_py() for c in keys)
            if key != now:
                if asked:
                    yield lines, table(asked)
                now, rows, lines, asked, n = key, [], None, [], 0
            if b.column("side")[s].as_py() == 0:
                rows.append(b.slice(s, e - s))
                continue
            if not rows and lines is None:
                continue
            if lines is None:
                lines, rows = Lines(*(table(rows)[c].to_numpy() for c in ("id", "idx", "x0", "y0", "x1", "y1"))), []
            while s < e:
                part = b.slice(s, min(e - s, at_once - n)).select(columns)
                asked.append(part)
                n += part.num_rows
                s += part.num_rows
                if n == at_once:
                    yield lines, table(asked)
                    asked, n = [], 0
    if asked:
        yield lines, table(asked)


def compact(x: np.ndarray, y: np.ndarray, rows: int):
    """Rows of places that lie close together, ``rows`` at a time; those without a place come alone."""
    some = np.isfinite(x) & np.isfinite(y)
    at = np.flatnonzero(some)
    at = at[np.argsort(x[at], kind="stable")]
    strip = -(-len(at) // max(1, int(np.ceil(np.sqrt(len(at) / rows))))) if len(at) else 1
    for i in range(0, len(at), strip):
        part = at[i : i + strip]
        part = part[np.argsort(y[part], kind="stable")]
        for k in range(0, len(part), rows):
            yield part[k : k + rows]
    none = np.flatnonzero(~some)
    for k in range(0, len(none), rows):
        yield none[k : k + rows]


class Lines:
    """Whole lines as segments, for the nearest point of each to places."""

    def __init__(self, line, idx, x0, y0, x1, y1):
        order = np.lexsort((idx, line))
        line, x0, y0, x1, y1 = (v[order] for v in (line, x0, y0, x1, y1))
        self.ids = line[np.append(True, line[1:] != line[:-1])]
        placed = np.isfinite(x0 + y0 + x1 + y1)
        line, self.x0, self.y0, x1, y1 = (v[placed] for v in (line, x0, y0, x1, y1))
        self.dx, self.dy = x1 - self.x0, y1 - self.y0
        self.l2 = self.dx * self.dx + self.dy * self.dy
        self.point = ~(self.l2 > 1e-12)
        self.some = bool(self.point.any())
        self.l2[self.point] = 1.0
        self.first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.n = np.diff(np.append(self.first, len(line)))
        self.has = np.searchsorted(self.ids, line[self.first])  # lines with a place

    def _measured(self, k, qx, qy):
        u, v, x0, y0 = (c[k] for c in (self.dx, self.dy, self.x0, self.y0))
        t = (qx - x0) * u
        t += (qy - y0) * v
        t /= self.l2[k]
        np.clip(t, 0.0, 1.0, out=t)
        if self.some:
            t[..., self.point[k]] = 0.0
        py = t * v
        px = np.multiply(t, u, out=t)
        px += x0
        py += y0
        return np.sqrt((qx - px) ** 2 + (qy - py) ** 2), px, py

    def nearest(self, qx, qy, at_once: int = 1 << 17):
        """(distances, x, y) of each line's nearest point (the first of equal ones), a row for each place; inf where there is none.

        Places should be close together: only segments that can hold the nearest point of one of them are measured for all.
        """
        out = np.full((3, len(qx), len(self.ids)), np.inf)
        if not len(self.first) or not np.isfinite(qx + qy).all():
            return out
        cx, cy = (qx.min() + qx.max()) / 2, (qy.min() + qy.max()) / 2
        far = self._measured(slice(None), cx, cy)[0]
        reach = (np.minimum.reduceat(far, self.first) + 2 * np.hypot(qx - cx, qy - cy).max()) * (1 + 1e-9) + 1e-9
        keep = far <= np.repeat(reach, self.n)
        n = np.add.reduceat(keep, self.first, dtype=np.int64)
        k, begin = np.flatnonzero(keep), np.cumsum(n) - n
        of_line, step = np.repeat(np.arange(len(n)), n), max(1, at_once // max(1, int(n.sum())))
        for at in range(0, len(qx), step):
            d, px, py = self._measured(k, qx[at : at + step, None], qy[at : at + step, None])
            least = np.minimum.reduceat(d, begin, axis=1)
            hit = np.flatnonzero(d == np.repeat(least, n, axis=1))
            if len(hit) != least.size:
                owner = hit // len(k) * len(n) + of_line[hit % len(k)]
                hit = hit[np.append(True, owner[1:] != owner[:-1])]
            for o, v in zip(out, (least, px.ravel()[hit].reshape(least.shape), py.ravel()[hit].reshape(least.shape))):
                o[at : at + step, self.has] = v
        return out


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """As SQL rounds: halves away from zero."""
    if digits is None:
        return v
    w = np.abs(v)
    w *= 10.0**digits
    w += 0.5
    np.floor(w, out=w)
    w /= 10.0**digits
    return np.copysign(w, v, out=w)


def _nearest(batches, digits: int | None):
    """From rows of ``passing`` batches of each query's nearest points."""
    for lines, asked in met(batches, ["id", "x0", "y0"], 16 * QUERIES):
        ids, qx, qy = (asked[c].to_numpy() for c in ("id", "x0", "y0"))
        for at in compact(qx, qy, 32):
            d, x, y = lines.nearest(qx[at], qy[at])
            none = np.isinf(d.ravel())
            none = none if none.any() else None
            columns = [np.repeat(ids[at], len(lines.ids)), np.tile(lines.ids, len(at)), *(rounded(c.ravel(), digits) for c in (d, x, y))]
            for k in range(0, d.size, 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(c[part], mask=none[part] if i > 1 and none is not None else None) for i, c in enumerate(columns)], schema=NEAREST)


def blocks(segments: pa.Table, ax: np.ndarray, ay: np.ndarray, rows: int = 16, at_once: int = 1 << 16):
    """(lines, of each block of ``rows`` places: where it begins, distances, x, y of each line's nearest point): whole lines at a time.

    segments: line_id, idx, x0, y0, x1, y1.  A distance is inf where a place or all of a line is missing.
    """
    line, idx = segments["line_id"].to_numpy(), segments["idx"].to_numpy()
    order = np.lexsort((idx, line))
    line = line[order]
    x0, y0, x1, y1 = (segments[c].to_numpy()[order] for c in ("x0", "y0", "x1", "y1"))
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    point = ~(l2 > 1e-12)
    some = bool(point.any())
    l2[point] = 1.0
    first = np.append(0, np.flatnonzero(line[1:] != line[:-1]) + 1)
    last = np.append(first[1:], len(line))
    blind = bool(np.isnan(x0 + y0 + x1 + y1).any() or np.isnan(ax + ay).any())  # where a coordinate is missing
    for at in range(0, len(ax), rows):
        qx, qy = ax[at : at + rows, None], ay[at : at + rows, None]
        found = []
        lo = 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(last, first[lo] + at_once // rows, side="right")))
            part = slice(first[lo], last[hi - 1])
            begin, n = first[lo:hi] - first[lo], last[lo:hi] - first[lo:hi]
            u, v = dx[part], dy[part]
            t = (qx - x0[part]) * u
            t += (qy - y0[part]) * v
            t /= l2[part]
            np.clip(t, 0.0, 1.0, out=t)
            if some:
                t[:, point[part]] = 0.0
            px, py = t * u, t * v
            px += x0[part]
            py += y0[part]
            d = np.sqrt((qx - px) ** 2 + (qy - py) ** 2)
            if blind:
                d[np.isnan(d)] = np.inf
            least = np.minimum.reduceat(d, begin, axis=1)
            hit = np.flatnonzero(d == np.repeat(least, n, axis=1))
            owner = hit // d.shape[1] * len(begin) + np.repeat(np.arange(len(begin)), n)[hit % d.shape[1]]
            fresh = np.ones(len(hit), bool)
            fresh[1:] = owner[1:] != owner[:-1]
            hit = hit[fresh]
            found.append((least, px.ravel()[hit].reshape(least.shape), py.ravel()[hit].reshape(least.shape)))
            lo = hi
        d, px, py = (np.concatenate(c, axis=1) for c in zip(*found))
        yield line[first], at, d, px, py


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by Douglas-Peucker with distances to the segment.

    All spans between kept points are looked at together, level by level: each span whose farthest point lies beyond the
    tolerance keeps that point (the first of equal ones), until no span does.
    """
    kept = np.arange(len(points))[[0, -1]] if len(points) > 1 else np.arange(len(points))
    while len(kept) < len(points):
        span = np.repeat(np.arange(len(kept) - 1), np.diff(kept))  # of the points kept[0] to kept[-1] - 1
        begin, chord = points[kept[span]], points[kept[span + 1]] - points[kept[span]]
        offset, square = points[kept[0] : kept[-1]] - begin, (chord**2).sum(axis=1)
        share = np.clip(np.divide((offset * chord).sum(axis=1), square, out=np.zeros(len(span)), where=square > 0), 0, 1)
        off = np.hypot(*(offset - share[:, None] * chord).T)
        farthest = np.maximum.reduceat(off, kept[:-1] - kept[0])
        hit = np.flatnonzero((off == farthest[span]) & (off > tolerance))
        if not len(hit):
            break
        _, first = np.unique(span[hit], return_index=True)
        kept = np.union1d(kept, hit[first] + kept[0])
    return kept


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Vertices kept by Douglas-Peucker, a line at a time, indices counted anew."""
    def one(g):
        g = g.sort_values("idx")
        kept = g.iloc[simplify(g[["x", "y"]].to_numpy(), tolerance)].copy()
        kept["idx"] = np.arange(len(kept))
        return kept[["line_id", "type", "idx", "x", "y"]]

    return vertices.groupBy("line_id").applyInPandas(one, "line_id bigint, type string, idx bigint, x double, y double")
