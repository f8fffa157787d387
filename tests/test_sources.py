import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cresthaven.operators import grid
from cresthaven.plans import job_queries, outputs, pipeline
from cresthaven.plans.config import Config
from cresthaven.sources import pointcloud as C
from cresthaven.sources.frames import terrace
from cresthaven.streaming.incremental import running_cells


def ply(points, order="<", names=("red", "green", "blue"), extra=b""):
    kind = "binary_little_endian" if order == "<" else "binary_big_endian"
    a = np.zeros(len(points), [("x", order + "f4"), ("y", order + "f8"), ("z", order + "f4"), *((n, "u1") for n in names)])
    for i, p in enumerate(points):
        a[i] = (*p[:3], *p[3 : 3 + len(names)])
    head = f"ply\nformat {kind} 1.0\ncomment made here\nelement vertex {len(points)}\nproperty float X\nproperty double Y\nproperty float Z\n" + "".join(f"property uchar {n}\n" for n in names) + "element face 0\nproperty list uchar int vertex_indices\nend_header\n"
    return head.encode() + a.tobytes() + extra


def las(points, kind=2):
    size = (20, 28, 26, 34)[kind]
    h = bytearray(227)
    h[:4] = b"LASF"
    h[24:26] = bytes([1, 2])
    struct.pack_into("<I", h, 96, 227)
    struct.pack_into("<BHI", h, 104, kind, size, len(points))
    struct.pack_into("<3d", h, 131, 0.01, 0.01, 0.001)
    struct.pack_into("<3d", h, 155, 100.0, 200.0, 0.0)
    out = bytes(h)
    for x, y, z, *rgb in points:
        r = bytearray(size)
        struct.pack_into("<3i", r, 0, round((x - 100) / 0.01), round((y - 200) / 0.01), round(z / 0.001))
        if kind > 1:
            struct.pack_into("<3H", r, 20 if kind == 2 else 28, *(c << 8 for c in rgb))
        out += bytes(r)
    return out + b"trailing"


POINTS = [(100.5 + i, 200.25 + i, 1.5 * i, i, 2 * i, 255) for i in range(50)]


@pytest.fixture
def cloud(spark):
    spark.dataSource.register(C.PointCloud)
    return lambda path, **o: spark.read.format("pointcloud").options(**o).load(str(path))


def rows(df):
    return sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.red, r.green, r.blue) for r in df.collect())


def test_files_folders_and_archives(cloud, tmp_path):
    want = sorted((x, y, z, r, g, b) for x, y, z, r, g, b in POINTS)
    (tmp_path / "a.ply").write_bytes(ply(POINTS, extra=b"12345"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "B.PLY").write_bytes(ply(POINTS, ">", ("diffuse_red", "g", "blue")))
    (tmp_path / "c.las").write_bytes(las(POINTS))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/e.las", las(POINTS, 3))
        z.writestr("readme.txt", "no")
    assert rows(cloud(tmp_path / "a.ply", pieceRecords=7)) == want
    assert cloud(tmp_path / "a.ply", pieceRecords=7).rdd.getNumPartitions() == 8
    assert rows(cloud(tmp_path / "c.las")) == want
    assert cloud(tmp_path).count() == 200 and {r.src for r in cloud(tmp_path).select("src").distinct().collect()} == {"a.ply", "B.PLY", "c.las", "in/e.las"}


def test_without_colour(cloud, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply(POINTS, names=()))
    (tmp_path / "b.las").write_bytes(las(POINTS, 1))
    assert all(r.red is None for r in cloud(tmp_path).collect())


@pytest.mark.parametrize("name,data", [("a.ply", b"ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n"), ("a.ply", b"ply\nformat binary_little_endian 1.0\n"), ("a.ply", b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n"), ("a.las", b"NOPE" + bytes(400)), ("a.las", las([], 0)[:104] + bytes([6]) + las([], 0)[105:])])
def test_bad_files(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(ValueError):
        C.layout(C.fs.LocalFileSystem(), str(tmp_path / name), None)


def test_nothing_found(tmp_path):
    with pytest.raises(FileNotFoundError):
        C.discover(str(tmp_path))


def test_round_trip(spark, cloud, tmp_path):
    df = terrace(spark).limit(500)
    df.write.format("pointcloud").mode("append").save(str(tmp_path / "out"))
    back = cloud(tmp_path / "out").drop("src")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_paths_are_uris(spark, cloud, tmp_path):
    """A folder by its URI, as in a remote store; colours that are missing are written as 0."""
    df = terrace(spark).limit(300).withColumn("red", F.lit(None).cast("smallint")).repartition(3)
    uri = (tmp_path / "far").as_uri()
    df.write.format("pointcloud").mode("append").save(uri)
    back = cloud(uri, pieceRecords=40)
    assert back.count() == 300 and back.select("src").distinct().count() == 3
    assert sorted(map(tuple, back.drop("src").collect())) == sorted(map(tuple, df.fillna(0, ["red"]).collect()))


def test_jobs_from_files(spark, tmp_path):
    for i, status in enumerate(["running", "succeeded", "queued"]):
        outputs.write_job({"id": f"SLOPE-{i}", "status": status, "logs": ["a"]}, str(tmp_path))
    (tmp_path / "SLOPE-9").mkdir()
    (tmp_path / "SLOPE-9" / "job.json").write_text("{broken")
    got = {r.id: r.status for r in job_queries.load_jobs(spark, f"{tmp_path}/SLOPE-*/job.json").collect()}
    assert got == {"SLOPE-0": "failed", "SLOPE-1": "succeeded", "SLOPE-2": "failed"}


def test_running_cells_equal_batch(spark, tmp_path):
    df = terrace(spark).where("x < 20 and y < 20")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_cells(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), -2.0, 22.0, 1.0)
    s = q.writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    s.awaitTermination(120)
    meta = spark.createDataFrame([(-2.0, 22.0, 1000, 1000)], "xmin double, ymax double, nx int, ny int")
    want = grid.half_cells(df, meta, 1.0).select("row", "col", "z", "cnt")
    assert sorted(map(tuple, spark.table("cells").select("row", "col", "z", "cnt").collect())) == sorted(map(tuple, want.collect()))


def test_many_lines_are_written_by_tasks(spark, tmp_path, monkeypatch):
    rows = [(k, "crest", [(0.0, float(k)), (5.0, float(k))], 5.0, "auto_edge_path" if k == 0 else None) for k in range(9)]
    lines = pipeline.lines_like(spark.createDataFrame(rows, f"line_id bigint, type string, pts {pipeline.POINTS}, length double, link_mode string"))
    c = Config(output=str(tmp_path / "l.geojson"), output_crs="ENU")
    whole = outputs.write_outputs(lines, c)
    monkeypatch.setattr(outputs, "MOST_IN_FILE", 5)
    parts = outputs.write_outputs(lines, c)
    for name, path in whole.items():
        want = json.loads(open(path, encoding="utf-8").read())["features"]
        got = [json.loads(r.value) for r in spark.read.text(parts[name]).collect()]
        assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want)) and len(want) == {"all": 9, "without_auto_gap": 8, "auto_gap": 1}[name.split(".")[0]]


def test_terrace_end_to_end(spark, tmp_path):
    c = Config(output=str(tmp_path / "lines.geojson"), output_crs="BOTH", guided_links=[{"type": "crest", "guide": [[40.0, 60.0], [60.0, 60.0], [84.0, 60.0]], "max_dz_m": 50, "id": "g"}])
    lines = pipeline.lines_of(terrace(spark, wavy=True), c)
    found = outputs.report(lines, c)
    counts = found["line_counts"]
    assert (counts["crest"] - counts["manual_constraint"], counts["toe"], counts["auto_gap"], counts["manual_constraint"]) == (3, 3, 0, 1)
    files = outputs.write_outputs(lines, c)
    assert len(files) == 6
    enu = json.loads(open(files["all.ENU"], encoding="utf-8").read())
    assert len(enu["features"]) == 7 and all(f["geometry"]["type"] == "LineString" for f in enu["features"])
    wgs = json.loads(open(files["all.WGS84"], encoding="utf-8").read())
    assert abs(wgs["features"][0]["geometry"]["coordinates"][0][0] - c.enu_origin["lon"]) < 0.01
    assert json.loads(open(files["auto_gap.ENU"], encoding="utf-8").read())["features"] == []
