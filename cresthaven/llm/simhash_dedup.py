"""SimHash near-duplicates by covering locality-sensitive hashing.

Every 64-bit fingerprint gets, for radius r, 2^(r+1)-1 masks.  Bit i carries a random vector phi(i) of r+1 bits;
mask v (v != 0) keeps the bits with <phi(i), v> = 1 modulo 2.  The at most r differing bits of a pair span at most
r dimensions, so some v is orthogonal to all of them: under that mask the two fingerprints are equal, hence every
pair within the radius meets in some table.  Buckets are searched exactly and give a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, groups, unwrapped, utf8, wrapped, written
from .components import components

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, width: int = 4) -> int:
    """The majority SimHash of the XXH64 (seed 42) values of a text's word shingles; A-Z are lower-cased, words part at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    m = len(h)
    padded = np.zeros((m + 254) // 255 * 255, np.uint64)
    padded[:m] = h
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        fps = np.fromiter((fingerprint(t) for t in utf8(b.column("text"))), np.uint64, b.num_rows)
        yield batch(FINGERPRINTS, b.column("doc_id"), pa.array(fps.view(np.int64)))


def masks(radius: int = 4, seed: int = 7) -> list[int]:
    """The covering family's masks, as signed 64-bit numbers."""
    phi = np.random.default_rng(seed).integers(1, 2 ** (radius + 1), 64)
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i in range(64) if int(phi[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges joining the distinct uint64 values of ``x`` that are linked within ``radius``: a star for each component."""
    if len(x) <= 12:
        v, root, out = x.tolist(), list(range(len(x))), []
        for i in range(len(v)):
            for j in range(i):
                if root[i] != root[j] and (v[i] ^ v[j]).bit_count() <= radius:
                    a, b = root[i], root[j]
                    root = [b if r == a else r for r in root]
        return [(v[i], v[r]) for i, r in enumerate(root) if i != r]
    out, rest = [], x
    while len(rest) > 1:
        first, rest, frontier = rest[0], rest[1:], [rest[0]]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                found = rest[near]
                out += [(int(f), int(first)) for f in found]
                frontier += list(found)
                rest = rest[~near]
    return out


def _bucket_edges(radius: int):
    def run(batches):
        for cols, starts in groups(batches, ["table", "key", "part"]):
            fps = cols["fp"].view(np.uint64)
            ends = np.append(starts[1:], len(fps))
            edges = [e for s, t in zip(starts.tolist(), ends.tolist()) if t - s > 1 for e in forest(fps[s:t], radius)]
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield batch(EDGES, pa.array(e[:, 0]), pa.array(e[:, 1]))

    return run


def links(fps: DataFrame, radius: int = 4, largest: int = 8192) -> DataFrame:
    """Distinct (fp) -> edges (a, b) that connect exactly what pairs within ``radius`` connect.

    A bucket of over ``largest`` fingerprints is dealt into chunks, and every pair of chunks is searched by a task of
    its own: nothing is left out, and no task holds more than about two chunks.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    large = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("table", "key", F.ceil(F.col("n") * 2 / largest).cast("int").alias("chunks"))
    large = written(large, "large")
    if large.isEmpty():
        rows = rows.select("table", "key", F.lit(0).alias("part"), "fp")
    else:
        rows = rows.join(large, ["table", "key"], "left")
        c, k = F.col("chunks"), F.pmod(F.xxhash64("fp"), F.col("chunks"))
        pairs = F.transform(F.sequence(F.lit(0), c - 1), lambda o: (F.least(k, o) * c + F.greatest(k, o)).cast("int"))
        rows = rows.select("table", "key", F.explode(F.when(c.isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"), "fp")
    dealt = rows.repartition("table", "key", "part").sortWithinPartitions("table", "key", "part")
    return dealt.mapInArrow(_bucket_edges(radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, fp (bigint), component_id.

    component_id is the least doc_id whose document is reachable over links of at most ``radius`` differing bits, the
    row's own included.  A null or empty text, or one of white space only, has fingerprint 0 and is linked like any
    other.  Null ids are kept; they never name a component that has another id (else component_id is null).  Repeated
    rows each give a row.  Extra columns are ignored.
    """
    own = written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "fingerprints")
    per_fp = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(own.select("fp").distinct(), radius))
    named = per_fp.join(roots, per_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The documents, all columns, that have the least doc_id of their component.

    Of rows that repeat an id the one whose columns come first stays (in the order of the whole row as JSON).  Rows
    with a null id stay only where their component has no other row.  Null and empty texts are near copies of one
    another; an empty table stays empty.  No column but doc_id and text is read, whatever the others are called.
    """
    labels = written(simhash_components(docs, radius), "components")
    keep = labels.where("doc_id <=> component_id").select("doc_id").distinct()
    rows = wrapped(docs, id=F.col("doc_id"))
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["doc_id"]), "left_semi")
    repeated = labels.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return unwrapped(kept, docs)
