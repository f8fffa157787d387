"""Sinks: features, feature collections, the run report, a preview picture, job records."""

from __future__ import annotations

import json
import os
import struct
import zlib
from dataclasses import asdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from .config import Config

PARTS = {"all": None, "without_auto_gap": False, "auto_gap": True}
COLOURS = {"crest": (220, 40, 40), "toe": (40, 90, 220), "inferred": (250, 160, 30), "auto_gap": (160, 40, 200), "manual_constraint": (20, 160, 90)}


def part(lines: DataFrame, name: str) -> DataFrame:
    """All lines, those without automatic bridges, or these alone."""
    gap = F.coalesce(F.col("link_mode") == "auto_edge_path", F.lit(False))
    want = PARTS[name]
    return lines if want is None else lines.where(gap == F.lit(want))


def write_features(lines: DataFrame, path: str, crs: str = "ENU", origin: dict | None = None) -> None:
    """A feature per text line, written by the tasks: the form for very many lines."""
    L.features(lines, crs, origin).select("feature").write.mode("overwrite").text(path)


def write_collection(lines: DataFrame, path: str, crs: str = "ENU", origin: dict | None = None) -> None:
    """One GeoJSON FeatureCollection; features pass the driver one partition at a time."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for k, row in enumerate(L.features(lines, crs, origin).orderBy("line_id").toLocalIterator()):
            f.write(("," if k else "") + row.feature)
        f.write("]}")
    os.replace(f"{path}.tmp", path)


MOST_IN_FILE = 200_000  # lines that go through the driver into one file


def write_outputs(lines: DataFrame, c: Config) -> dict[str, str]:
    """The three parts in the configured coordinates (or both) beside ``output``; name -> path.

    Over ``MOST_IN_FILE`` lines do not pass the driver: each part is then a folder ``....features`` of text files, a
    feature a line, written by the tasks.
    """
    out, base = {}, c.output.removesuffix(".geojson")
    large = lines.count() > MOST_IN_FILE
    for crs in ("ENU", "WGS84") if c.output_crs == "BOTH" else (c.output_crs,):
        for name in PARTS:
            path = base + ("" if name == "all" else f".{name}") + (f".{crs.lower()}" if c.output_crs == "BOTH" else "") + ".geojson"
            if large:
                path = path.removesuffix(".geojson") + ".features"
            (write_features if large else write_collection)(part(lines, name), path, crs, c.enu_origin)
            out[f"{name}.{crs}"] = path
    return out


def report(lines: DataFrame, c: Config) -> dict:
    """The run's parameters, line counts and total length."""
    row = L.counts(lines).first().asDict()
    total = row.pop("total_length_m")
    params = {k: v for k, v in asdict(c).items() if k not in ("input", "output", "enu_origin")}
    return {"input": c.input, "output": c.output, "params": params, "enu_origin": c.enu_origin, "line_counts": row, "total_length_m": total}


def styles(lines: DataFrame) -> DataFrame:
    """line_id, colour class: by how the line came about, else by type."""
    mode = L.connection_mode(F.col("link_mode"))
    return lines.select("line_id", F.when(mode.isin("inferred", "auto_gap", "manual_constraint"), mode).otherwise(F.col("type")).alias("style"))


def png(pixels: np.ndarray) -> bytes:
    """(h, w, 3) bytes as a PNG file."""
    h, w, _ = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def preview(surface, lines: DataFrame, path: str, most: int = 2000) -> None:
    """A picture of at most ``most`` pixels a side: heights in grey, lines in colour."""
    from ..operators import polyline

    k = max(1, -(-max(surface.nx, surface.ny) // most))
    h, w = -(-surface.ny // k), -(-surface.nx // k)
    cells = surface.dsm.groupBy((F.floor(F.col("row") / k)).alias("r"), (F.floor(F.col("col") / k)).alias("c")).agg(F.avg("z").alias("z")).toPandas()
    image = np.full((h, w, 3), 200, np.uint8)
    if len(cells):
        z = cells["z"].to_numpy(float)
        z = np.nan_to_num((z - np.nanmin(z)) / max(np.nanmax(z) - np.nanmin(z), 1e-9))
        image[cells["r"].astype(int), cells["c"].astype(int)] = (60 + 160 * z)[:, None].astype(np.uint8)
    drawn = surface.place(polyline.resample(polyline.unpacked(lines), surface.res)).join(styles(lines), "line_id")
    for r in drawn.select((F.floor(F.col("row") / k)).cast("int").alias("r"), (F.floor(F.col("col") / k)).cast("int").alias("c"), "style").distinct().toLocalIterator():
        image[r.r, r.c] = COLOURS[r.style]
    Path(path).write_bytes(png(image))


def write_job(job: dict, folder: str) -> None:
    """A job's record, replaced as a whole."""
    path = Path(folder, job["id"], "job.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.with_suffix(".tmp").write_text(json.dumps(job, ensure_ascii=False), encoding="utf-8")
    path.with_suffix(".tmp").replace(path)
