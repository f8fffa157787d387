"""Scores, modes, geodesy and feature rows of lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
MODES = ["regular_edge", "edge_supported_short", "edge_supported_long", "regular_low_evidence", "geometry_inferred"]
BASE_CONFIDENCE = [0.95, 0.88, 0.82, 0.68, 0.45]


def link_mode(edge_fraction: Column, least: float, regular: Column, short: Column, inferred: Column) -> Column:
    ok = edge_fraction >= least
    return F.when(regular & ok, MODES[0]).when(short & ok, MODES[1]).when(inferred & ok, MODES[2]).when(regular, MODES[3]).when(inferred, MODES[4])


def mode_rank(mode: Column) -> Column:
    out = F.lit(4)
    for k, m in enumerate(MODES[:4]):
        out = F.when(mode == m, k).otherwise(out)
    return out


def link_confidence(mode: Column, edge_fraction: Column, gap: Column, most: float) -> Column:
    base = F.lit(None).cast("double")
    for m, c in zip(MODES, BASE_CONFIDENCE):
        base = F.when(mode == m, c).otherwise(base)
    return F.greatest(F.lit(0.20), F.least(F.lit(0.99), base + 0.10 * edge_fraction - 0.12 * F.least(F.lit(1.0), gap / max(most, 1e-6))))


def bridge_score(support: Column, novelty: Column, ratio: Column) -> Column:
    quality = 1 - F.least(F.greatest(ratio - 1, F.lit(0.0)) / 0.7, F.lit(1.0))
    return 0.55 * support + 0.35 * novelty + 0.10 * quality


def link_score(cost: Column, gap: Column, cos: Column, edge_fraction: Column, mode: Column) -> Column:
    """What links are ranked by within a mode: the path's cost a cell, the gap, bends and missing evidence; the least is best."""
    return cost + 0.015 * gap + 0.35 * (1 - cos) - 0.45 * edge_fraction + F.when(mode == "geometry_inferred", 0.35).otherwise(0.0)


def multiscale_confidence(edge_fraction: Column) -> Column:
    return F.greatest(F.lit(0.20), F.least(F.lit(0.95), 0.62 + 0.30 * edge_fraction))


def evidence_class(support: Column, novelty: Column, ratio: Column, c) -> Column:
    """strong, weak or NULL, by a bridge's edge support, novelty and length ratio; ``c`` is a Config."""
    limits = lambda a, b, m: (support >= a) & (novelty >= b) & (ratio <= m)
    strong = limits(c.auto_gap_edge_support_2m_min, c.auto_gap_novelty_min, c.auto_gap_length_ratio_max)
    weak = limits(c.auto_gap_weak_edge_support_2m_min, c.auto_gap_weak_novelty_min, max(c.auto_gap_length_ratio_max, 1.55))
    return F.when(strong, "strong").when(weak, "weak")


def protected(source: Column, seed_region: Column, regions: list) -> Column:
    """Seeded lines that linking leaves alone: of the given regions, or of all where none is given."""
    seeded = F.coalesce(source.isin("edge_seed", "edge_seed_linked"), F.lit(False))
    return seeded & (F.coalesce(seed_region, F.lit(-1)).isin(*regions) if regions else F.lit(True))


def in_regions(pts: Column, regions: list, buffer: float) -> Column:
    """Whether any vertex lies in any of the rectangles (x, y, x, y; corners in any order), made wider by ``buffer`` on all sides."""
    boxes = [(min(x0, x1) - buffer, max(x0, x1) + buffer, min(y0, y1) - buffer, max(y0, y1) + buffer) for x0, y0, x1, y1 in regions]
    return F.exists(pts, lambda p: F.array_contains(F.array(*(p.x.between(x0, x1) & p.y.between(y0, y1) for x0, x1, y0, y1 in boxes)), True))


def merged_mode(a: Column, b: Column, now: Column) -> Column:
    """The weakest mode of two parents and their link, in the order below, else the link's."""
    out = now
    for m in (MODES[0], MODES[1], MODES[2], MODES[4]):
        out = F.when((a == m) | (b == m) | (now == m), m).otherwise(out)
    return out


def merged_source(a: Column, b: Column) -> Column:
    one = lambda s: (a == s) & (b == s)
    any_ = lambda s: (a == s) | (b == s)
    return F.when(one("edge_seed"), "edge_seed").when(any_("edge_seed"), "edge_seed_linked").when(one("multiscale_seed"), "multiscale_seed").when(any_("multiscale_seed"), "multiscale_linked").otherwise("platform_boundary")


def connection_mode(mode: Column) -> Column:
    return F.when(mode == "geometry_inferred", "inferred").when(mode.isNull() | (mode == "observed"), "observed").when(mode == "manual_guided", "manual_constraint").when(mode == "auto_edge_path", "auto_gap").otherwise("linked")


def mean_known(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


def geodetic(east: Column, north: Column, origin: dict, rounds: int = 8) -> tuple[Column, Column]:
    """(lon, lat) in degrees of local east and north metres about ``origin`` {lat, lon, h}, at its height.

    Through earth-centred coordinates; the latitude by ``rounds`` fixed-point steps.
    """
    import math

    lat0, lon0, h = math.radians(origin["lat"]), math.radians(origin["lon"]), origin["h"]
    e2 = FLATTENING * (2 - FLATTENING)
    sin, cos, slon, clon = math.sin(lat0), math.cos(lat0), math.sin(lon0), math.cos(lon0)
    n0 = AXIS / math.sqrt(1 - e2 * sin * sin)
    x = (n0 + h) * cos * clon - east * slon - north * (sin * clon)
    y = (n0 + h) * cos * slon + east * clon - north * (sin * slon)
    z = (n0 * (1 - e2) + h) * sin + north * cos
    p = F.sqrt(x * x + y * y)
    start = F.atan2(z, p * (1 - e2))

    def step(acc, _):
        n = AXIS / F.sqrt(1 - e2 * F.sin(acc) * F.sin(acc))
        height = p / F.cos(acc) - n
        return F.atan2(z, p * (1 - e2 * n / (n + height)))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def features(lines: DataFrame, crs: str = "ENU", origin: dict | None = None) -> DataFrame:
    """lines (line_id, type, pts, length, z, link_mode, confidence, source and, where there are any, details) -> line_id, feature: a GeoJSON feature as text."""
    mode = F.coalesce("link_mode", F.lit("observed"))
    have = set(lines.columns)

    def part(names, when, digits=None):
        return [F.when(mode == when, F.round(F.col(s), (digits or {}).get(n, 2)) if n in (digits or {}) else F.col(s)).alias(n) for n, s in names if s in have]

    manual = part([("constraint_id", "constraint_id"), ("guide_length_m", "guide_length_m")], "manual_guided", {"guide_length_m": 2})
    gap = part([("auto_gap_method", "auto_gap_method"), ("evidence_class", "evidence_class"), ("path_length_m", "path_length_m"), ("edge_support_2m", "edge_support_2m"), ("path_novelty_fraction", "path_novelty_fraction"), ("length_ratio", "length_ratio")], "auto_edge_path", {"path_length_m": 2, "edge_support_2m": 4, "path_novelty_fraction": 4, "length_ratio": 4})
    both = [F.when(mode.isin("manual_guided", "auto_edge_path"), F.round(s, 2) if s.endswith("_m") else F.col(s)).alias(n) for n, s in [("anchor_line_start_index", "anchor_line_start"), ("anchor_line_end_index", "anchor_line_end"), ("anchor_gap_m", "anchor_gap_m"), ("anchor_dz_m", "anchor_dz_m")] if s in have]
    properties = F.struct(
        F.col("type").alias("line"), F.when(F.col("type") == "crest", "坡顶线").otherwise("坡脚线").alias("line_cn"), F.round("length", 2).alias("length_m"), F.round("z", 2).alias("z_m"), mode.alias("link_mode"),
        connection_mode(mode).alias("connection_mode"), F.round(F.coalesce("confidence", F.lit(1.0)), 2).alias("confidence"), F.coalesce("source", F.lit("platform_boundary")).alias("source"),
        (mode == "geometry_inferred").alias("is_inferred"), (mode == "manual_guided").alias("is_manual_constraint"), (mode == "auto_edge_path").alias("is_auto_gap"), *both, *manual, *gap,
    )
    if crs == "ENU":
        coordinates = F.transform("pts", lambda p: F.array(F.round(p.x, 3), F.round(p.y, 3)))
    else:
        coordinates = F.transform("pts", lambda p: F.array(*(F.round(c, 7) for c in geodetic(p.x, p.y, origin))))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return lines.select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def counts(lines: DataFrame) -> DataFrame:
    """The report's line counts and total length, one row."""
    mode, source = F.coalesce("link_mode", F.lit("observed")), F.coalesce("source", F.lit("platform_boundary"))
    return lines.agg(
        F.count_if(F.col("type") == "crest").alias("crest"), F.count_if(F.col("type") == "toe").alias("toe"), F.count_if(mode == "geometry_inferred").alias("inferred"),
        F.count_if(mode.startswith("edge_supported")).alias("edge_supported"), F.count_if(source.startswith("edge_seed")).alias("edge_seed"), F.count_if(source.startswith("multiscale")).alias("multiscale_seed"),
        F.count_if(source == "manual_constraint").alias("manual_constraint"), F.count_if(source == "auto_gap_bridge").alias("auto_gap"), F.round(F.coalesce(F.sum("length"), F.lit(0.0)), 2).alias("total_length_m"),
    )
