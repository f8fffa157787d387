"""Point cloud files as Spark tables: binary PLY and LAS 0-3, alone or in ZIP archives, and a PLY writer.

``spark.dataSource.register(PointCloud)``, then ``spark.read.format("pointcloud").load(path)``: a file, a folder (with
its subfolders) or an archive.  Files are cut into byte ranges of whole records, so a large file is read by many tasks;
archive members are read by one task each.  Paths may be URIs of a remote store.
"""

from __future__ import annotations

import io
import os
import struct
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "src string, x double, y double, z double, red smallint, green smallint, blue smallint"
ARROW = pa.schema([("src", pa.string()), *((c, pa.float64()) for c in "xyz"), *((c, pa.int16()) for c in ("red", "green", "blue"))])
BATCH = 200_000
SUFFIXES = (".ply", ".las")
# PLY's scalar types, and names under which colours appear.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLOURS = {"red": ("red", "diffuse_red", "r"), "green": ("green", "diffuse_green", "g"), "blue": ("blue", "diffuse_blue", "b")}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, or by its URI any that pyarrow knows: hdfs, s3, gs, ...) and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def discover(path: str) -> list[tuple[str, str | None]]:
    """(file, archive member or None) of every cloud under a path, sorted, each once; files as paths in the path's own file system."""
    files_in, top = store(path)
    if files_in.get_file_info(top).type == fs.FileType.Directory:
        files = sorted(i.path for i in files_in.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file and i.path.lower().endswith((*SUFFIXES, ".zip")))
    else:
        files = [top]
    found: list[tuple[str, str | None]] = []
    for f in files:
        if f.lower().endswith(".zip"):
            with opened(files_in, f) as raw, zipfile.ZipFile(raw) as z:
                found += [(f, n) for n in sorted(z.namelist()) if n.lower().endswith(SUFFIXES)]
        elif f.lower().endswith(SUFFIXES):
            found.append((f, None))
    if not found:
        raise FileNotFoundError(f"no point cloud in {path}")
    return found


def opened(files_in: fs.FileSystem, file: str):
    return io.BufferedReader(files_in.open_input_file(file), 1 << 20)


def open_member(files_in: fs.FileSystem, file: str, member: str | None):
    raw = opened(files_in, file)
    return raw if member is None else zipfile.ZipFile(raw).open(member)


@dataclass
class Layout:
    """Where a file's records begin, how many there are, their numpy type, and how to get points from them."""

    start: int
    count: int
    record: np.dtype
    scale: tuple | None = None
    offset: tuple | None = None
    names: dict | None = None

    def points(self, raw: bytes, src: str) -> pa.RecordBatch:
        a = np.frombuffer(raw, self.record)
        if self.scale:
            xyz = [a[c].astype(float) * s + o for c, s, o in zip("xyz", self.scale, self.offset)]
            rgb = [(a[c] >> 8).astype(np.int16) for c in ("red", "green", "blue")] if "red" in (self.record.names or ()) else None
        else:
            xyz = [a[self.names[c]].astype(float) for c in "xyz"]
            rgb = [a[self.names[c]].astype(np.int16) for c in COLOURS] if all(c in self.names for c in COLOURS) else None
        rgb = rgb or [pa.nulls(len(a), pa.int16())] * 3
        return pa.RecordBatch.from_arrays([pa.array([src] * len(a), pa.string()), *map(pa.array, xyz), *(c if isinstance(c, pa.Array) else pa.array(c) for c in rgb)], schema=ARROW)


def ply_layout(f) -> Layout:
    lines, size = [], 0
    while not lines or lines[-1] != "end_header":
        raw = f.readline()
        if not raw or size > 1 << 20:
            raise ValueError("PLY: no end_header")
        size += len(raw)
        lines.append(raw.decode("ascii", "replace").strip())
    if lines[0] != "ply":
        raise ValueError("PLY: no signature")
    form, count, fields, inside, first = "", None, [], False, True
    for words in (x.split() for x in lines[1:] if x):
        if words[0] == "format":
            form = words[1]
        elif words[0] == "element":
            inside = words[1] == "vertex"
            if inside:
                if not first:
                    raise ValueError("PLY: vertex must be the first element")
                count = int(words[2])
            first = False
        elif words[0] == "property" and inside:
            if words[1] == "list":
                raise ValueError("PLY: list properties of vertices are not supported")
            fields.append((words[2].lower(), words[1]))
    if form not in ("binary_little_endian", "binary_big_endian"):
        raise ValueError(f"PLY: format {form} is not supported")
    order = "<" if form == "binary_little_endian" else ">"
    record = np.dtype([(n, order + PLY_TYPES[t]) for n, t in fields])
    names = {c: c for c in "xyz" if c in record.names}
    if len(names) < 3 or count is None:
        raise ValueError("PLY: x, y and z are needed")
    for c, options in COLOURS.items():
        if own := next((o for o in options if o in record.names), None):
            names[c] = own
    return Layout(size, count, record, names=names)


def las_layout(f) -> Layout:
    h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError("LAS: no signature")
    minor = h[25]
    start, = struct.unpack_from("<I", h, 96)
    kind, length, count = struct.unpack_from("<BHI", h, 104)
    if minor >= 4 and len(h) >= 255 and (wide := struct.unpack_from("<Q", h, 247)[0]):
        count = wide
    if kind > 3:
        raise ValueError(f"LAS: point format {kind} is not supported")
    length = length or (20, 28, 26, 34)[kind]
    fields = {"names": ["x", "y", "z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": length}
    if kind in (2, 3):
        at = 20 if kind == 2 else 28
        fields["names"] += list(COLOURS)
        fields["formats"] += ["<u2"] * 3
        fields["offsets"] += [at, at + 2, at + 4]
    return Layout(start, count, np.dtype(fields), struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155))


def layout(files_in: fs.FileSystem, file: str, member: str | None) -> Layout:
    with open_member(files_in, file, member) as f:
        return (ply_layout if (member or file).lower().endswith(".ply") else las_layout)(f)


class Piece(InputPartition):
    def __init__(self, file, member, first, count):
        self.file, self.member, self.first, self.count = file, member, first, count


class Reader(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self):
        files_in, _ = store(self.path)
        out = []
        for file, member in discover(self.path):
            l = layout(files_in, file, member)
            if member is None:  # records that the file really holds
                l.count = min(l.count, max(0, files_in.get_file_info(file).size - l.start) // l.record.itemsize)
            step = self.piece if member is None else max(l.count, 1)
            out += [Piece(file, member, at, min(step, l.count - at)) for at in range(0, max(l.count, 1), step)]
        return out

    def read(self, p: Piece):
        files_in, _ = store(self.path)
        l = layout(files_in, p.file, p.member)
        src = p.member or p.file.rpartition("/")[2]
        size = l.record.itemsize
        with open_member(files_in, p.file, p.member) as f:
            if p.member is None:
                f.seek(l.start + p.first * size)
            else:
                f.read(l.start)
            left = p.count
            while left > 0:
                raw = f.read(min(left, BATCH) * size)
                n = len(raw) // size
                if not n:
                    break
                yield l.points(raw[: n * size], src)
                left -= n


class PlyWriter(DataSourceArrowWriter):
    """Each task's points as one PLY file in the folder, written batch by batch; a name appears when its file is whole, so a task that runs again does no harm."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches):
        from pyspark import TaskContext

        files_in, folder = store(self.path)
        files_in.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        count = 0
        with files_in.open_output_stream(f"{name}.body") as f:
            for b in batches:
                a = np.empty(b.num_rows, dtype=[(c, "<f8") for c in "xyz"] + [(c, "u1") for c in COLOURS])
                for c in a.dtype.names:
                    a[c] = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                f.write(a.tobytes())
                count += len(a)
        with files_in.open_output_stream(f"{name}.tmp") as f, files_in.open_input_stream(f"{name}.body") as body:
            f.write(ply_header(count, "double"))
            while part := body.read(1 << 22):
                f.write(part)
        files_in.delete_file(f"{name}.body")
        files_in.move(f"{name}.tmp", f"{name}.ply")
        return WriterCommitMessage()


def ply_header(count: int, kind: str = "float") -> bytes:
    fields = [f"property {kind} {c}" for c in "xyz"] + [f"property uchar {c}" for c in COLOURS]
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", *fields, "end_header\n"]).encode()


class PointCloud(DataSource):
    @classmethod
    def name(cls):
        return "pointcloud"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("pieceRecords", 4_000_000)))

    def writer(self, schema, overwrite):
        return PlyWriter(self.options["path"])
