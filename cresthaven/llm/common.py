"""Shared pieces: written tables in the shared folder, Arrow helpers, label split."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)  # stands for a null id: before all others


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a context's checkpoint folder where that is unset.

    Only a local session may do without either; it gets a folder of its own, which a cluster's executors could not see.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cresthaven-"))
        path = context.getCheckpointDir()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return path.rstrip("/")


_folders: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the process ends (where pyarrow knows the store)."""
    folder = f"{shared_dir(spark)}/cresthaven-{spark.sparkContext.applicationId}"
    if not _folders:
        atexit.register(_remove_folders)
    _folders.add(folder)
    return folder


def _remove_folders() -> None:
    for folder in _folders:
        with contextlib.suppress(OSError, pa.ArrowException):
            fs, path = pa_fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
            fs.delete_dir(path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files whose plans are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def wrapped(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns, and every row of ``docs`` whole as the struct ``row``: no column of its own can clash with ours."""
    return docs.select(*(c.alias(name) for name, c in columns.items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as they were before ``wrapped``."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    """True for rows whose labels must not be learned from (crc32 of the id as text); a null id counts as the text ''."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus) == remainder


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches, rows: int = 1024):
    """The batches in slices of at most ``rows`` rows, which bounds what a task holds of them as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def groups(batches, keys: list[str], largest: int = 1 << 16):
    """From batches sorted by ``keys`` yield (dict of numpy columns, start offsets) with whole groups only.

    Rows of the last, perhaps unfinished, group are carried to the next batch.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < largest:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = _changes(t, keys)
        if not len(change):
            held = t.to_batches()
            continue
        cut = int(change[-1])
        yield _columns(t.slice(0, cut)), np.concatenate([[0], change[:-1]])
        held = t.slice(cut).to_batches()
        n = sum(x.num_rows for x in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield _columns(t), np.concatenate([[0], _changes(t, keys)])


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t[c].to_numpy() for c in t.column_names}


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    differs = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        v = t[k].to_numpy()
        differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1
