"""The terrain pipeline: cloud -> surface -> lines -> links -> bridges -> features and report.

Rasters stay distributed tables of cells; lines are rows with an array of points.  Only the grid's one-row geometry,
line counts and pass decisions reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import components, grid, polyline, raster, routing, selection, spatial
from ..operators.components import cut
from ..operators.relief import relief
from .config import Config

POINTS = "array<struct<x:double,y:double>>"
COLUMNS = {"line_id": "bigint", "type": "string", "pts": POINTS, "length": "double", "z": "double", "source": "string", "link_mode": "string", "confidence": "double", "edge_fraction": "double", "seed_region": "int", "constraint_id": "string", "anchor_line_start": "bigint", "anchor_line_end": "bigint", "anchor_gap_m": "double", "anchor_dz_m": "double", "guide_length_m": "double", "auto_gap_method": "string", "evidence_class": "string", "path_length_m": "double", "edge_support_2m": "double", "path_novelty_fraction": "double", "length_ratio": "double"}


def lines_like(df: DataFrame) -> DataFrame:
    """Exactly the line columns, NULL where ``df`` has none."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


@dataclass
class Surface:
    """dsm: (row, col, z, slope, nx, ny) of the data region; the grid's geometry."""

    dsm: DataFrame
    res: float
    xmin: float
    ymax: float
    nx: int
    ny: int

    def place(self, points: DataFrame) -> DataFrame:
        return polyline.to_cells(points, self.xmin, self.ymax, self.res, self.nx, self.ny)

    def centre(self, row, col):
        return grid.centre(row, col, self.xmin, self.ymax, self.res)


def surface(points: DataFrame, c: Config) -> Surface | None:
    """Rasterise, fill, smooth and slope; None for a cloud without a valid point."""
    cells, meta = grid.build(points, c.grid_res_m)
    m = meta.first()
    if m is None:
        return None
    cells = cut(cells.select("row", "col", "z"))
    # three cells around the data are kept; from there the slope looks one cell on, the smoothing ``reach``, the median one
    reach = len(raster.gaussian_weights(c.smooth_sigma_cells)) // 2 if c.smooth_sigma_cells > 0 else 0
    filled = raster.fill(cells, 3.0 + math.ceil(math.sqrt(2) * (reach + 2))).where(f"row >= 0 and col >= 0 and row < {m.ny} and col < {m.nx}").withColumns({"nx": F.lit(m.nx), "ny": F.lit(m.ny)})
    filled = cut(filled)
    smooth = raster.gaussian(raster.median3(filled), c.smooth_sigma_cells, m.nx, m.ny) if c.smooth_sigma_cells > 0 else raster.median3(filled)
    kept = filled.where("d2 <= 9").select("row", "col", "nx", "ny").join(smooth, ["row", "col"])
    sloped = raster.slope(kept, c.grid_res_m).withColumns({"nx": F.lit(m.nx), "ny": F.lit(m.ny)})
    return Surface(cut(sloped), c.grid_res_m, m.xmin, m.ymax, m.nx, m.ny)


def from_chains(chained: DataFrame, s: Surface, c: Config, least: float, source: str, ident) -> DataFrame:
    """(label, type, chain, idx, row, col) -> lines of at least ``least`` metres, simplified; z: the median along the whole chain."""
    x, y = s.centre(F.col("row"), F.col("col"))
    v = chained.select(ident.alias("line_id"), "type", "idx", "row", "col", x.alias("x"), y.alias("y"))
    z = v.join(s.dsm.select("row", "col", "z"), ["row", "col"], "left").groupBy("line_id").agg(F.median("z").alias("z"))
    simple = polyline.simplified(v.select("line_id", "type", "idx", "x", "y"), c.simplify_tol_m)
    simple = cut(simple)
    long = polyline.lengths(simple).where((F.col("length") >= least) & (F.col("n") > 1)).select("line_id", "length")
    return lines_like(polyline.packed(simple).join(long, "line_id").join(z, "line_id", "left").withColumn("source", F.lit(source)))


def paired(edges: DataFrame) -> DataFrame:
    """(label, type, row, col): the n-th component with crest cells goes with the n-th with toe cells; those beyond the shorter list go."""
    there = edges.select("label", "type").distinct()
    n = {r.type: r.n for r in there.groupBy("type").agg(F.count("*").alias("n")).collect()}  # two rows
    most = min(n.get("crest", 0), n.get("toe", 0))
    places = None
    for kind in ("crest", "toe"):
        one = components.numbered(there.where(F.col("type") == kind).select("label"), "label", "place").where(F.col("place") <= most).select("label", F.lit(kind).alias("type"))
        places = one if places is None else places.unionByName(one)
    return edges.join(places, ["label", "type"], "left_semi")


def extract(s: Surface, c: Config, stage: int = 0) -> DataFrame:
    """Platforms, their crest and toe cells, chains and lines; then lines from seeded step edges."""
    mask = s.dsm.where(F.col("slope") < c.platform_slope_deg).select("row", "col")
    mask = raster.opening(raster.closing(mask, raster.disk(2), s.nx, s.ny), raster.disk(1), s.nx, s.ny)
    mask = cut(components.remove_small(cut(mask), c.min_platform_px))
    labels = cut(components.labels(mask))
    edges = raster.ray_edges(labels, s.dsm, c.ray_m, c.grid_res_m, c.min_step_drop_m, boxed=c.compat)
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("crest"), "crest"), F.when(F.col("toe"), "toe"))))
    edges = edges.select("label", kinds.alias("type"), "row", "col")
    chained = selection.chains(paired(cut(edges)) if c.compat else edges, ["label", "type"], c.min_arc_px, c.compat)
    ident = (F.lit(stage) * (1 << 56)) + F.col("label") * (1 << 24) + F.col("chain") * 2 + F.when(F.col("type") == "toe", 1).otherwise(0)
    lines = cut(from_chains(chained, s, c, c.min_line_m, "platform_boundary", ident))
    if not c.edge_seed_enabled:
        return lines
    for k, rectangle in enumerate(c.edge_seed_regions):
        if rectangle is None:
            continue
        own = (c.edge_seed_region_params[k] if k < len(c.edge_seed_region_params) else None) or {}
        get = lambda n, d: own.get(n, d)
        step = raster.step_edges(s.dsm.select("row", "col", "z", "slope"), c.ray_m, c.grid_res_m, get("drop_m", c.edge_seed_drop_m), get("center_slope_deg", c.edge_seed_center_slope_deg))
        step = raster.in_rectangle(step, rectangle, s.xmin, s.ymax, s.res)
        taken = s.place(polyline.unpacked(lines)).select("type", "row", "col").distinct()
        reach = get("dedup_dist_m", c.edge_seed_dedup_dist_m) / s.res
        near = raster.scatter(taken, raster.disk(reach), "type").select("type", "row", "col").distinct()
        fresh = cut(step.join(near, ["type", "row", "col"], "left_anti"))
        for kind in ("crest", "toe"):
            part = components.remove_small(fresh.where(F.col("type") == kind).select("row", "col"), get("min_px", c.edge_seed_min_px))
            part = part.withColumns({"label": F.lit(k).cast("bigint"), "type": F.lit(kind)})
            chained = selection.chains(part, ["label", "type"], get("min_px", c.edge_seed_min_px), c.compat)
            seeded = from_chains(chained, s, c, get("min_line_m", c.edge_seed_min_line_m), "edge_seed", F.lit(1 << 55) + ident)
            lines = cut(lines.unionByName(seeded.withColumn("seed_region", F.lit(k))))
    return lines


def step_mask(s: Surface, c: Config, drop: float, centre: float) -> DataFrame:
    """(type, row, col) of direct step edges."""
    return raster.step_edges(s.dsm.select("row", "col", "z", "slope"), c.ray_m, c.grid_res_m, drop, centre)


def near_edges(mask: DataFrame, reach: float) -> DataFrame:
    """(type, row, col, d2): squared distance, in cells, to the nearest edge cell of the type, up to ``reach``."""
    out = None
    for kind in ("crest", "toe"):
        d = raster.fill(mask.where(F.col("type") == kind).select("row", "col", F.lit(1.0).alias("z")), reach).select(F.lit(kind).alias("type"), "row", "col", "d2")
        out = d if out is None else out.unionByName(d)
    return out


def multiscale(lines: DataFrame, s: Surface, c: Config) -> DataFrame:
    """Add lines of relaxed platforms that follow step edges and are no duplicates."""
    if not c.multiscale_enabled:
        return lines
    relaxed = extract(s, c.but(platform_slope_deg=c.multiscale_slope_deg, min_platform_px=c.multiscale_min_platform_px, min_line_m=c.multiscale_min_line_m, edge_seed_enabled=False), stage=1)
    near = near_edges(step_mask(s, c, c.multiscale_drop_m, c.multiscale_edge_center_slope_deg), c.multiscale_edge_dist_m / s.res)
    samples = s.place(polyline.resample(polyline.unpacked(relaxed), 1.0)).join(relaxed.select("line_id", "length"), "line_id")
    samples = samples.join(near, ["type", "row", "col"], "left").select("line_id", "type", "length", "k", "row", "col", (F.sqrt("d2") * s.res).alias("d_edge"))
    taken = s.place(polyline.resample(polyline.unpacked(lines), s.res))
    accepted = selection.accept(samples, taken, c)
    added = relaxed.drop("edge_fraction").join(accepted, "line_id").withColumns({"source": F.lit("multiscale_seed"), "confidence": L.multiscale_confidence(F.col("edge_fraction"))})
    return cut(lines.unionByName(lines_like(added)))


def edt(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest set cell; infinite without one."""
    h, w = mask.shape
    d = np.where(mask, 0.0, np.inf)
    for r in range(1, h):
        d[r] = np.minimum(d[r], d[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        d[r] = np.minimum(d[r], d[r + 1] + 1)
    gap = (np.arange(w)[:, None] - np.arange(w)[None]) ** 2
    return np.sqrt((d[:, None, :] ** 2 + gap[None]).min(axis=2))


ROUTED = "cid bigint, path_cost double, n int, edge_fraction double, novelty double, path_length double, path " + POINTS


def distances(cells: DataFrame, s: Surface, name: str) -> DataFrame:
    """(type, row, col) -> (row, col, crest_<name>, toe_<name>): distance, in cells, to the nearest of the type in the whole grid; only types that have cells."""
    d = raster.nearest(cells.select("type", "row", "col"), s.nx, s.ny, "type")
    return cut(d.groupBy("row", "col").agg(*(F.max(F.when(F.col("kind") == t, F.sqrt("d2"))).alias(f"{t}_{name}") for t in ("crest", "toe"))))


def routed(candidates: DataFrame, s: Surface, edges: DataFrame, taken: DataFrame, filled: DataFrame, pad, cost, near_m: float, tolerance: float | None) -> DataFrame:
    """Least-cost paths of candidates (cid, type, x0, y0, z0, x1, y1, z1, r0, c0, r1, c1), each in its window.

    cost(edge, line, z, x, y, candidate) gives the window's costs from distances (in cells) to step edges and lines of
    the type, ``edges`` and ``taken`` as of ``distances``; a type without any counts as the grid's diagonal away.
    """
    cells = edges.join(taken, ["row", "col"], "full").join(filled.select("row", "col", "z"), ["row", "col"], "full")
    w = routing.windows(candidates.withColumn("pad", pad), cells, F.col("pad"))
    own = lambda k: F.when(F.col("type") == "crest", F.col(f"crest_{k}")).otherwise(F.col(f"toe_{k}")).alias(k)
    names = ["cid", "pad", "x0", "y0", "z0", "x1", "y1", "z1", "r0", "c0", "r1", "c1"]
    w = w.select(*names, "row", "col", "z", own("edge"), own("line"))
    res, xmin, ymax, ny, nx = s.res, s.xmin, s.ymax, s.ny, s.nx
    empty = pd.DataFrame({n.split()[0]: [] for n in ROUTED.split(", ", 6)[:6]} | {"path": []})

    def one(g: pd.DataFrame) -> pd.DataFrame:
        f = g.iloc[0]
        pad_ = int(f["pad"])
        top, left = max(0, int(min(f.r0, f.r1)) - pad_), max(0, int(min(f.c0, f.c1)) - pad_)
        bottom, right = min(ny - 1, int(max(f.r0, f.r1)) + pad_), min(nx - 1, int(max(f.c0, f.c1)) + pad_)
        z = np.full((bottom - top + 1, right - left + 1), np.nan)
        far = float(np.hypot(ny, nx))
        d_edge, d_line = np.full(z.shape, far), np.full(z.shape, far)
        r, c_ = g["row"].to_numpy() - top, g["col"].to_numpy() - left
        ok = (r >= 0) & (c_ >= 0) & (r < z.shape[0]) & (c_ < z.shape[1])
        r, c_ = r[ok], c_[ok]
        z[r, c_], d_edge[r, c_], d_line[r, c_] = g["z"][ok], g["edge"][ok].fillna(far), g["line"][ok].fillna(far)
        yy, xx = np.mgrid[top : bottom + 1, left : right + 1]
        price = cost(d_edge, d_line, z, xmin + (xx + 0.5) * res, ymax - (yy + 0.5) * res, f)
        price[~np.isfinite(z)] = routing.NO_DATA
        found = routing.dijkstra(price, (int(f.r0) - top, int(f.c0) - left), (int(f.r1) - top, int(f.c1) - left))
        if not found:
            return empty
        path = np.array(found[0])
        xy = np.column_stack([xmin + (path[:, 1] + left + 0.5) * res, ymax - (path[:, 0] + top + 0.5) * res])
        at = (path[:, 0], path[:, 1])
        kept = xy
        if tolerance is not None:
            kept = xy[1:-1]
            kept = kept[polyline.simplify(kept, tolerance)] if tolerance and len(kept) > 2 else kept
        return pd.DataFrame({"cid": [g["cid"].iloc[0]], "path_cost": [found[1]], "n": [len(path)], "edge_fraction": [float((d_edge[at] <= near_m).mean())], "novelty": [float((d_line[at] * res >= 3.0).mean())], "path_length": [float(np.hypot(*np.diff(xy, axis=0).T).sum())], "path": [[{"x": x, "y": y} for x, y in kept.tolist()]]})

    return w.groupBy("cid").applyInPandas(one, ROUTED)


def along(d, f, x, y):
    """Share of the way along the chord, clipped."""
    vx, vy = f.x1 - f.x0, f.y1 - f.y0
    return np.clip(((x - f.x0) * vx + (y - f.y0) * vy) / max(vx * vx + vy * vy, 1e-9), 0, 1)


def merge(pairs: DataFrame, lines: DataFrame, number: int = 0, enhanced: bool = True) -> DataFrame:
    """Pairs (first_line, which0, second_line, which1, type, path, mode, confidence, edge_fraction) -> the lines they make, without their lengths.

    Each runs along the first line to its end which0, along the path, and along the second from its end which1 on.
    Heights are the mean of the known ones; source, mode and confidence are those of the weakest part.
    """
    one = lambda k, name: lines.select(F.col("line_id").alias(name), *(F.col(n).alias(f"{n}_{k}") for n in ("pts", "z", "link_mode", "confidence", "source")))
    m = pairs.withColumnsRenamed({"confidence": "new_confidence"}).join(one("a", "first_line"), "first_line").join(one("b", "second_line"), "second_line")
    front = F.when(F.col("which0") == "s", F.reverse("pts_a")).otherwise(F.col("pts_a"))
    rear = F.when(F.col("which1") == "e", F.reverse("pts_b")).otherwise(F.col("pts_b"))
    base = lambda x: F.coalesce(x, F.lit("platform_boundary"))
    parts = [F.lit("linked").alias("link_mode")]
    if enhanced:
        parts = [L.merged_source(base(F.col("source_a")), base(F.col("source_b"))).alias("source"), L.merged_mode(F.col("link_mode_a"), F.col("link_mode_b"), F.col("mode")).alias("link_mode"), F.least(F.coalesce("confidence_a", F.lit(1.0)), F.coalesce("confidence_b", F.lit(1.0)), "new_confidence").alias("confidence"), "edge_fraction"]
    return m.select(F.xxhash64("first_line", "second_line", F.lit(number)).alias("line_id"), "type", F.concat(front, "path", rear).alias("pts"), L.mean_known(F.col("z_a"), F.col("z_b")).alias("z"), *parts)


def link(lines: DataFrame, s: Surface, c: Config, enhanced: bool = True) -> DataFrame:
    """Join fragments end to end along least-cost paths, one-to-one, for up to ``link_passes`` passes."""
    if c.link_gap_m <= 0:
        return lines
    filled = cut(raster.fill(s.dsm.select("row", "col", "z"), 6.0))
    edges = distances(step_mask(s, c, c.min_step_drop_m, c.platform_slope_deg + 10.0), s, "edge")
    w_dist, w_z, w_edge = c.link_w_dist, c.link_w_z, c.link_w_edge if enhanced else 0.0

    def cost(edge, line, z, x, y, f):
        t = along(None, f, x, y)
        return 1 + w_dist * line + w_z * np.abs(z - (f.z0 + t * (f.z1 - f.z0))) + (w_edge * edge if w_edge else 0.0)

    for number in range(c.link_passes):
        v = cut(polyline.unpacked(lines))
        ends = s.place(polyline.tangents(v)).join(filled.select("row", "col", "z"), ["row", "col"])
        ends = ends.withColumn("end_id", F.xxhash64("line_id", "which"))
        if enhanced and c.edge_seed_protect_links:
            ends = ends.join(lines.where(L.protected(F.col("source"), F.col("seed_region"), c.edge_seed_protected_region_indices)).select("line_id"), "line_id", "left_anti")
        ends = cut(ends)
        if enhanced:
            pairs = spatial.top_per_endpoint(cut(spatial.link_pairs_enhanced(ends, c)), max(1, int(c.link_max_candidates_per_endpoint)))
        else:
            pairs = spatial.link_pairs(ends, c.link_gap_m, c.link_dz_max_m, c.link_min_cos, c.link_lateral_max_m).withColumns({"cos": F.least("cos_first", "cos_second"), "regular": F.lit(True), "short": F.lit(False), "inferred": F.lit(False)})
        pairs = cut(pairs.withColumn("cid", F.xxhash64("first", "second")))
        if pairs.isEmpty():
            break
        side = lambda e, k: ends.select(F.col("end_id").alias(e), F.col("which").alias(f"which{k}"), *(F.col(n).alias(f"{m}{k}") for n, m in (("x", "x"), ("y", "y"), ("z", "z"), ("row", "r"), ("col", "c"))))
        cand = cut(pairs.join(side("first", 0), "first").join(side("second", 1), "second"))
        pad = F.floor(0.5 * F.col("gap") / s.res).cast("int") + (4 if enhanced else 3)
        taken = distances(s.place(v), s, "line")
        paths = routed(cand, s, edges, taken, filled, pad, cost, c.link_edge_dist_m, max(0.8, c.simplify_tol_m * 0.8) if enhanced else 0.0)
        scored = cand.join(paths, "cid")
        per = F.col("path_cost") / F.greatest("n", F.lit(1))
        if enhanced:
            scored = scored.withColumn("mode", L.link_mode(F.col("edge_fraction"), c.link_edge_min_fraction, F.col("regular"), F.col("short"), F.col("inferred"))).where("mode is not null")
            scored = scored.withColumns({"rank": L.mode_rank(F.col("mode")), "confidence": L.link_confidence(F.col("mode"), F.col("edge_fraction"), F.col("gap"), c.link_infer_gap_m)})
            scored = scored.withColumn("score", L.link_score(per, F.col("gap"), F.col("cos"), F.col("edge_fraction"), F.col("mode")))
        else:
            scored = scored.withColumns({"mode": F.lit(None).cast("string"), "rank": F.lit(0), "confidence": F.lit(None).cast("double"), "score": per + 0.02 * F.col("gap")})
        taken_pairs = cut(selection.match(cut(scored), ["rank", "score"]))
        if taken_pairs.isEmpty():
            break
        m = merge(taken_pairs, lines, number, enhanced)
        m = cut(m)
        m = m.join(polyline.lengths(polyline.unpacked(m)).select("line_id", "length"), "line_id")
        used = taken_pairs.select(F.explode(F.array("first_line", "second_line")).alias("line_id"))
        lines = cut(lines_like(m).unionByName(lines.join(used, "line_id", "left_anti")))
    return lines


def link_local(lines: DataFrame, s: Surface, c: Config) -> DataFrame:
    """Enhanced linking with relaxed limits of the lines with a vertex in a buffered seed region."""
    regions = [r for r in c.edge_seed_regions if r]
    if not (c.edge_seed_local_link_enabled and regions):
        return lines
    inside = cut(lines.where(L.in_regions(F.col("pts"), regions, c.edge_seed_local_link_buffer_m)))
    gap = c.edge_seed_local_link_gap_m
    local = c.but(link_gap_m=gap, link_infer_gap_m=gap, link_dz_max_m=c.edge_seed_local_link_dz_max_m, link_infer_dz_max_m=c.edge_seed_local_link_dz_max_m, link_min_cos=c.edge_seed_local_link_min_cos, link_infer_min_cos=c.edge_seed_local_link_min_cos, link_lateral_max_m=c.edge_seed_local_link_lateral_max_m, link_infer_lateral_max_m=c.edge_seed_local_link_lateral_max_m, edge_seed_protect_links=False)
    return cut(lines.join(inside.select("line_id"), "line_id", "left_anti").unionByName(link(inside, s, local)))


def validate(lines: DataFrame, s: Surface, c: Config) -> DataFrame:
    """Lines across which the ground falls or rises by ``min_face_height_m`` in the median."""
    v = cut(polyline.unpacked(lines))
    r = relief(polyline.sample_tangents(polyline.resample(v, 2.0, "never"), v), s.dsm, s.place)
    return cut(lines.join(r.where(F.col("relief") >= c.min_face_height_m).select("line_id"), "line_id", "left_semi"))


def bridge(lines: DataFrame, s: Surface, c: Config) -> DataFrame:
    """Automatic bridges between near lines of a type along step edges."""
    if not c.auto_gap_enabled:
        return lines
    step, most = c.auto_gap_sample_step_m, c.auto_gap_max_m
    samples = cut(polyline.resample(polyline.unpacked(lines), step, "reached"))
    near = spatial.nearest_samples(samples, most + 2 * step)  # a little more than the limit: neighbours of smoothed values
    smooth = polyline.smooth3(near, "d", ["first", "second"], "k")
    minima = polyline.local_minima(smooth, "smooth", ["first", "second"], "k", most)
    picked = polyline.separated(minima, "smooth", ["first", "second"], "k", max(1, round(20.0 / step)))
    ends = lambda n, k, p: samples.select(F.col("line_id").alias(n), F.col("k").alias(k), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}"))
    q = near.join(picked, ["first", "second", "k"]).join(ends("first", "k", 0), ["first", "k"]).join(ends("second", "k2", 1), ["second", "k2"])
    q = q.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2, "gap": polyline.norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})
    pair = [F.least("first", "second"), F.greatest("first", "second")]
    q = spatial.first_per_key(q, [*pair, F.bround(F.col("mx") / 10), F.bround(F.col("my") / 10), F.bround(F.col("gap") / 10)], ["first", "k"])
    q = cut(q.where(F.col("gap").between(c.auto_gap_min_m, most)).withColumn("cid", F.xxhash64("first", "second", "k")))
    edges = cut(step_mask(s, c, c.auto_gap_edge_drop_m, c.auto_gap_edge_center_slope_deg))
    taken = cut(s.place(polyline.resample(polyline.unpacked(lines), max(0.5, s.res / 2))).select("type", "row", "col").distinct())
    # the chord's evidence; the gates look no farther than 8 m
    t = F.col("t") / 30.0
    chord = s.place(q.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(30)))).select("cid", "type", (F.col("x0") * (1 - t) + F.col("x1") * t).alias("x"), (F.col("y0") * (1 - t) + F.col("y1") * t).alias("y")))
    to_edge = near_edges(edges, 8.5 / s.res).select("type", "row", "col", F.col("d2").alias("de"))
    to_line = near_edges(taken, 3.0 / s.res).select("type", "row", "col", F.col("d2").alias("dl"))
    e = chord.join(to_edge, ["type", "row", "col"], "left").join(to_line, ["type", "row", "col"], "left").select("cid", F.coalesce(F.sqrt("de") * s.res, F.lit(1e9)).alias("de"), F.coalesce(F.sqrt("dl") * s.res, F.lit(1e9)).alias("dl"))
    g = e.groupBy("cid").agg(F.median("de").alias("med"), F.avg(F.when(F.col("de") <= 4.0, 1.0).otherwise(0.0)).alias("near4"), F.avg(F.when(F.col("dl") >= 3.0, 1.0).otherwise(0.0)).alias("new"))
    q = q.join(g.where("med <= 8.0 and near4 >= 0.35 and new >= 0.20"), "cid").withColumn("quick", F.col("gap") + 3.0 * F.col("med") - 20.0 * F.col("near4") - 10.0 * F.col("new"))
    q = cut(q.orderBy("quick", "cid").limit(max(1, int(c.auto_gap_max_path_candidates))))
    if q.isEmpty():
        return lines
    # heights without limit: the nearest known one, however far
    known = s.dsm.where("z is not null").select("row", "col", "z")
    source = raster.nearest(known.select(F.lit(0).alias("kind"), "row", "col"), s.nx, s.ny).select("row", "col", "sr", "sc")
    filled = cut(source.join(known.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z"), ["sr", "sc"]).select("row", "col", "z"))
    at = lambda p: s.place(q.select("cid", F.col(f"x{p}").alias("x"), F.col(f"y{p}").alias("y"))).join(filled.select("row", "col", "z"), ["row", "col"], "left").select("cid", F.col("row").alias(f"r{p}"), F.col("col").alias(f"c{p}"), F.col("z").alias(f"z{p}"))
    cand = cut(q.join(at(0), "cid").join(at(1), "cid"))
    res = s.res

    def cost(edge, line, z, x, y, f):
        vx, vy = f.x1 - f.x0, f.y1 - f.y0
        lateral = np.abs((x - f.x0) * vy - (y - f.y0) * vx) / np.sqrt(max(vx * vx + vy * vy, 1e-9))
        return 1 + 4.0 * edge * res + 0.03 * lateral + 0.5 * np.abs(z - (f.z0 + along(None, f, x, y) * (f.z1 - f.z0)))

    paths = routed(cand, s, distances(edges, s, "edge"), distances(taken, s, "line"), filled, F.lit(int(20.0 / s.res) + 4), cost, 2.0 / s.res, None)
    r = cand.join(paths, "cid").withColumn("ratio", F.col("path_length") / F.greatest("gap", F.lit(1e-9)))
    r = r.withColumn("evidence_class", L.evidence_class(F.col("edge_fraction"), F.col("novelty"), F.col("ratio"), c)).where("evidence_class is not null")
    r = r.withColumn("score", L.bridge_score(F.col("edge_fraction"), F.col("novelty"), F.col("ratio")))
    r = cut(r.withColumnsRenamed({"first": "first_line", "second": "second_line"}))
    kept = selection.thin(r, c.auto_gap_nms_radius_m, max(1, int(c.auto_gap_max_bridges)))
    point = lambda p: F.array(F.struct(F.col(f"x{p}").alias("x"), F.col(f"y{p}").alias("y")))
    b = r.join(kept, "cid").withColumn("pts", polyline.deduplicate(F.concat(point(0), "path", point(1)), max(0.10, s.res * 0.25), True)).where(F.size("pts") > 1)
    b = b.select(F.col("cid").alias("line_id"), "type", "pts", F.coalesce(L.mean_known(F.col("z0"), F.col("z1")), F.lit(0.0)).alias("z"), F.lit("auto_gap_bridge").alias("source"), F.lit("auto_edge_path").alias("link_mode"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("confidence"), "evidence_class", F.col("first_line").alias("anchor_line_start"), F.col("second_line").alias("anchor_line_end"), F.col("gap").alias("anchor_gap_m"), F.col("path_length").alias("path_length_m"), F.col("edge_fraction").alias("edge_support_2m"), F.col("novelty").alias("path_novelty_fraction"), F.col("ratio").alias("length_ratio"), F.lit("minimum_cost_step_edge_path").alias("auto_gap_method"))
    b = cut(b)
    b = b.join(polyline.lengths(polyline.unpacked(b)).select("line_id", "length"), "line_id")
    return cut(lines.unionByName(lines_like(b)))


def guide(lines: DataFrame, c: Config) -> DataFrame:
    """Connectors along the user's guides, between the lines nearest to their ends."""
    spark = lines.sparkSession
    rows = []
    for k, g in enumerate(c.guided_links):
        pts = g.get("guide", []) if isinstance(g, dict) else []
        if len(pts) > 1:
            either = g.get("max_endpoint_dist_m", 50.0)
            rows.append((k, g.get("type", "crest"), *map(float, pts[0]), *map(float, pts[-1]), float(g.get("max_endpoint_dist_start_m", either)), float(g.get("max_endpoint_dist_end_m", either)), float(g.get("max_gap_m", g.get("max_anchor_gap_m", 100.0))), float(g.get("max_dz_m", float("inf"))), str(g.get("id", k)), [{"x": float(x), "y": float(y)} for x, y in pts]))
    if not rows:
        return lines
    guides = spark.createDataFrame(rows, f"guide_id bigint, type string, sx double, sy double, ex double, ey double, ms double, me double, mg double, mz double, constraint_id string, guide {POINTS}")
    base = lines.where("source is null or source != 'manual_constraint'")
    widest = max(max(r[6], r[7]) for r in rows)
    found = spatial.anchors(guides, polyline.unpacked(base), base.select("line_id", "z"), widest, max(r[8] for r in rows), None, guides.select("guide_id", "ms", "me", "mg", "mz"))
    a = found.join(guides, "guide_id")
    ends = [F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))) for x, y in (("ax", "ay"), ("bx", "by"))]
    a = a.withColumn("pts", polyline.deduplicate(F.concat(ends[0], "guide", ends[1]), 0.05, False))
    z = base.select("line_id", "z")
    a = a.join(z.withColumnsRenamed({"line_id": "start_line", "z": "za"}), "start_line").join(z.withColumnsRenamed({"line_id": "end_line", "z": "zb"}), "end_line")
    a = a.select(F.xxhash64("guide_id", F.lit("guide")).alias("line_id"), "type", "pts", L.mean_known(F.col("za"), F.col("zb")).alias("z"), F.lit("manual_constraint").alias("source"), F.lit("manual_guided").alias("link_mode"), F.lit(0.90).alias("confidence"), "constraint_id", F.col("start_line").alias("anchor_line_start"), F.col("end_line").alias("anchor_line_end"), F.col("gap").alias("anchor_gap_m"), F.col("dz").alias("anchor_dz_m"), "guide")
    a = cut(a)
    long = polyline.lengths(polyline.unpacked(a)).select("line_id", "length")
    whole = polyline.lengths(polyline.unpacked(a.withColumn("pts", F.col("guide")))).select("line_id", F.col("length").alias("guide_length_m"))
    return cut(lines.unionByName(lines_like(a.join(long, "line_id").join(whole, "line_id"))))


def lines_of(points: DataFrame, c: Config) -> DataFrame:
    """All lines of a cloud: (line_id, type, pts, length, z, source, link_mode, confidence, ...)."""
    s = surface(points, c)
    if s is None:
        return lines_like(points.sparkSession.createDataFrame([], "line_id bigint"))
    found = extract(s, c)
    found = multiscale(found, s, c)
    found = link(found, s, c, c.enhanced_link)
    found = link_local(found, s, c)
    found = validate(found, s, c)
    found = bridge(found, s, c)
    return guide(found, c)
