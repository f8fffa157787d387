"""Exact substring removal with a range-partitioned suffix sort.

A byte is removed if a ``length``-byte string that covers it also starts earlier: in a document of smaller id, or
earlier in the same one.  All ``length``-byte strings of a document fall into runs that share an *anchor*, the
leftmost ``gram``-byte string of least hash within them, so equal strings have equal anchors at equal offsets.

1. Spark counts the anchors' hashes.  A run whose anchor occurs once holds nothing that occurs elsewhere; it goes no
   further.  A Bloom filter of the repeated anchors (at most ``MOST_BITS`` bits; beyond what these can hold it lets more
   rows pass) thins out the rest before an exact semi-join, so only suspect runs are shuffled.
2. Of equal suspect runs the first stays.  Where an anchor has different runs, their firsts go on, as the suffixes that
   start at the anchor, with the bytes before it.
3. Spark samples splitters and range-partitions these suffixes by their leading bytes (ties: document, offset, so a
   hot anchor spreads over many buckets).  Each bucket sorts the strings of its suffixes by multikey quicksort and
   finds the first of each.  What touches a bucket's first or last anchor is compared across boundaries by a minimum.
4. Each document gets its suspect runs, which of them are first, and the strings found to be repeats, and drops the
   bytes that repeats cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batch, release, sliced, utf8, written

GRAM = 32
MOST_BITS = 1 << 29
LEAST_HOT = 500  # an anchor with fewer rows is never hot
CHUNK = 1 << 22  # starts handled at once, so that memory does not follow a text's length
_BITS = np.uint64(24)
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

COUNTS = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])
RUNS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64())])
SUFFIXES = pa.schema([("suffix", pa.binary()), ("before", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64())])
FOUND = pa.schema([("border", pa.bool_()), ("gram", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64())])


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"


def runs(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(starts, ends, anchors, anchors' hashes) of the maximal runs: strings that start in [start, end) share the anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    parts = [_runs(np.frombuffer(data, np.uint8, min(n - at, CHUNK) + length - 1, at), length, gram, at) for at in range(0, n, CHUNK)]
    return tuple(np.concatenate(c) for c in zip(*parts))


def _runs(raw: np.ndarray, length: int, gram: int, at: int):
    h, size, k = _BYTES[raw], 1, 0
    while size * 2 <= gram:
        h = h[:-size] * _ODD[k] + h[size:]
        size, k = size * 2, k + 1
    if size < gram:
        h = h[: len(h) - (gram - size)] * _ODD[5] + h[gram - size :]
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    whole = h
    h = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    window, size = length - gram + 1, 1
    while size * 2 <= window:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < window:
        h = np.minimum(h[: len(h) - (window - size)], h[window - size :])
    anchor = (h & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.append(0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1)
    return first + at, np.append(first[1:], len(anchor)) + at, anchor[first] + at, whole[anchor[first]]


def _anchor_counts(length: int, gram: int, flush: int = 1 << 20):
    def run(batches):
        held, n = [], 0

        def emit():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return batch(COUNTS, values.view(np.int64), counts)

        for b in batches:
            for text in utf8(b.column("text")):
                h = runs(text, length, gram)[3]
                if len(h):
                    held.append(h)
                    n += len(h)
                if n > flush:
                    yield emit()
                    held, n = [], 0
        if held:
            yield emit()

    return run


def spark_hash(a: np.ndarray, salt: int) -> np.ndarray:
    """Spark's xxhash64(bigint a, int salt)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = mixed(turn((np.uint64(42) + p5 + np.uint64(8)) ^ (turn(a * p2, 31) * p1), 27) * p1 + p4)
        return mixed(turn((h + p5 + np.uint64(4)) ^ (np.uint64(salt) * p1), 23) * p2 + p3)


def _bloom(repeated: DataFrame, count: int) -> tuple[np.ndarray, int, int]:
    """(words, log2 of the bits, probes) of a Bloom filter; Spark sets the bits, the driver gets at most MOST_BITS of them."""
    size = max(16, min(MOST_BITS.bit_length() - 1, (12 * max(count, 1)).bit_length()))
    probes = max(1, min(4, round(0.69 * (1 << size) / max(count, 1))))
    bits = repeated.select(F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64("anchor", F.lit(i)), 64 - size) for i in range(probes)))).alias("bit"))
    one = F.lit(1).cast("bigint")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))).alias("value"))
    t = words.toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[t["word"].to_numpy()] = t["value"].to_numpy().view(np.uint64)
    return out, size, probes


def _run_rows(length: int, gram: int, shared):
    def run(batches):
        words, size, probes = shared.value
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list] = [[] for _ in RUNS]
            for text, doc, key in zip(utf8(b.column("text")), b.column("doc").to_pylist(), b.column("key").to_pylist()):
                starts, ends, _, h = runs(text, length, gram)
                pick = np.ones(len(h), bool)
                for i in range(probes):
                    bit = spark_hash(h, i) >> np.uint64(64 - size)
                    pick &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(pick)
                s = starts[at].tolist()
                r = [digest(text[x : y + length - 1]) for x, y in zip(s, ends[at].tolist())]
                for c, v in zip(out, (h[at].view(np.int64).tolist(), np.array(r, np.uint64).view(np.int64).tolist(), [doc] * len(s), [key] * len(s), s)):
                    c += v
                if len(s) and len(out[0]) > 50_000:
                    yield batch(RUNS, *out)
                    out = [[] for _ in RUNS]
            yield batch(RUNS, *out)

    return run


def _suffix_rows(length: int, gram: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, doc, key, wanted in zip(utf8(b.column("text")), b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("starts").to_pylist()):
                starts, ends, anchors, _ = runs(text, length, gram)
                at = np.searchsorted(starts, np.array(wanted, np.int64))
                for s, e, a in zip(starts[at].tolist(), ends[at].tolist(), anchors[at].tolist()):
                    for c, v in zip(out, (text[a : e + length - 1], text[s:a], doc, key, s)):
                        c.append(v)
                if len(out[0]) > 20_000:
                    yield batch(SUFFIXES, *out)
                    out = [[], [], [], [], []]
            yield batch(SUFFIXES, *out)

    return run


def multikey_quicksort(words: np.ndarray, small: int = 1024) -> np.ndarray:
    """The order that sorts rows of big-endian uint64 words: three-way partitions on one word, equal rows go one word deeper."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        w = words[part, depth]
        pivot = np.sort(w[:: max(1, len(w) // 64)])[len(w[:: max(1, len(w) // 64)]) // 2]
        less, equal = w < pivot, w == pivot
        a, e, c = part[less], part[equal], part[w > pivot]
        order[lo:hi] = np.concatenate([a, e, c])
        stack += [(lo, lo + len(a), depth), (lo + len(a), lo + len(a) + len(e), depth + 1), (hi - len(c), hi, depth)]
    return order


def _firsts(strings: list[bytes], doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int):
    """Every ``length``-byte string of each of ``strings`` (of which doc, key and start are given), with whether it is the first of its kind here.

    Returns (index of the string's owner, offset within it, first).
    """
    joined = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[owner] + offset
    full = length // 8
    every = np.lib.stride_tricks.sliding_window_view(joined, 8)
    packed = np.ascontiguousarray(every).view(">u8").ravel().astype(np.uint64)  # the 8 bytes from each place on
    words = np.empty((len(at), full + bool(length % 8)), np.uint64)
    for k in range(full):
        words[:, k] = packed[at + 8 * k]
    if length % 8:
        words[:, full] = packed[at + length - 8]
    order = multikey_quicksort(words)
    same = np.zeros(len(order), bool)
    same[1:] = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same)
    rank = np.lexsort((start[owner] + offset, key[owner], doc[owner], kind))
    fresh = np.ones(len(rank), bool)
    fresh[1:] = kind[rank[1:]] != kind[rank[:-1]]
    first = np.empty(len(rank), bool)
    first[rank] = fresh
    return owner, offset, first


def _sorted_bucket(length: int, gram: int, at_once: int = 6000):
    """A bucket's suffixes -> the strings that are repeats, and the first ones at its first and last anchor."""

    def solve(rows, ends):
        strings = [b + s for s, b, *_ in rows]
        doc, key, start = (np.array(c, np.int64) for c in zip(*(r[2:] for r in rows)))
        owner, offset, first = _firsts(strings, doc, key, start, length)
        places = lambda at: (doc[owner[at]], key[owner[at]], start[owner[at]] + offset[at])
        again = np.flatnonzero(~first)
        yield batch(FOUND, np.zeros(len(again), bool), pa.nulls(len(again), pa.binary()), *places(again))
        edge = np.fromiter((r[0][:gram] in ends for r in rows), bool, len(rows))
        at = np.flatnonzero(first & edge[owner])
        digest = xxhash.xxh3_128_digest
        yield batch(FOUND, np.ones(len(at), bool), [digest(strings[i][j : j + length]) for i, j in zip(owner[at].tolist(), offset[at].tolist())], *places(at))

    def run(batches):
        rows = list({r[2:]: r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))}.values())  # repeated rows once
        if not rows:
            return
        rows.sort(key=lambda r: r[0][:gram])  # by anchor; the strings themselves are sorted below
        ends = {rows[0][0][:gram], rows[-1][0][:gram]}
        lo = 0
        while lo < len(rows):
            hi = min(lo + at_once, len(rows))
            while hi < len(rows) and rows[hi][0][:gram] == rows[hi - 1][0][:gram]:
                hi += 1
            yield from solve(rows[lo:hi], ends)
            lo = hi

    return run


def _covered(n: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [begin, end) spans covered by ``length`` bytes from each of the sorted starts on."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length


def cut(text: bytes, suspects, firsts, repeats, length: int = 100, gram: int = GRAM) -> tuple[bytes, int, int]:
    """(kept bytes, removed, spans) of a text: of the runs at ``suspects`` all but those at ``firsts`` go, and the strings at ``repeats``."""
    again = np.setdiff1d(np.asarray(suspects, np.int64), np.asarray(firsts, np.int64))
    if not len(again) and not len(repeats):
        return text, 0, 0
    every = np.zeros(0, np.int64)
    if len(again):
        starts, ends, *_ = runs(text, length, gram)
        n = ends[np.searchsorted(starts, again)] - again
        every = np.repeat(again - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    begin, end = _covered(len(text), np.unique(np.concatenate([every, np.asarray(repeats, np.int64)])), length)
    kept, at = [], 0
    for b, e in zip(begin.tolist(), end.tolist()):
        kept.append(text[at:b])
        at = e
    kept.append(text[at:])
    return b"".join(kept), int((end - begin).sum()), len(begin)


def _cut_rows(schema: pa.Schema, length: int, gram: int, keep: bool):
    def run(batches):
        for b in sliced(batches):
            texts = utf8(b.column("text"))
            none = [None] * len(texts)
            marks = b.column("marks")
            values, ends = marks.values.to_numpy(), marks.offsets.to_numpy()
            out = []
            for k, text in enumerate(texts):
                mark = values[ends[k] : ends[k + 1]] if marks[k].is_valid else values[:0]
                out.append(cut(text, *(mark[mark & 3 == kind] >> 2 for kind in range(3)), length, gram) if len(mark) else (text, 0, 0))
            more = [[None if t is None else k[0].decode("utf-8", "ignore") for t, k in zip(b.column("text").to_pylist(), out)]] if keep else [none]
            rest = [b.column(f.name) for f in list(schema)[:-5]]
            yield batch(schema, *rest, [len(t) for t in texts], [o[1] for o in out], [o[2] for o in out], [hashlib.sha256(o[0]).hexdigest() for o in out], *more)

    return run


def _hot(counted: DataFrame, total: int, parts: int) -> DataFrame:
    """(anchor, n) -> (anchor, salts) for anchors with over a partition's share of the rows: at most as many as partitions, so they are broadcast."""
    share = max(total // parts, LEAST_HOT)
    return F.broadcast(written(counted.where(F.col("n") > share).select("anchor", F.ceil(F.col("n") / share).cast("int").alias("salts")), "hot-anchors"))


def _salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (anchor, doc, key, start, ...) of hot anchors dealt over salts."""
    salt = F.coalesce(F.pmod(F.xxhash64("doc", "key", "start"), "salts"), F.lit(0)).cast("int")
    return rows.join(hot, "anchor", "left").withColumn("salt", salt).drop("salts")


def _copied(anchors: DataFrame, hot: DataFrame) -> DataFrame:
    """Hot anchors once for each salt."""
    return anchors.select("anchor").join(hot, "anchor", "left").select("anchor", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"))


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, ...) -> a row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless keep_text).

    Null text counts as empty bytes (kept_text stays null); texts shorter than ``length`` keep all.  Null ids come
    first.  Rows that share an id are separate documents in the order of a hash of their text; rows that repeat id and
    text are one document, all with its result.  kept_text drops the bytes of characters that a cut has split.
    Extra columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    return _removed(rows, ["doc_id"], length, keep_text, gram)


def _removed(rows: DataFrame, carry: list[str], length: int, keep_text: bool, gram: int) -> DataFrame:
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = "struct<doc:bigint,key:bigint,start:bigint>"
    least_place = F.min(F.struct("doc", "key", "start")).cast(place).alias("p")
    own = rows.select("doc", "key", "text")
    counts = own.select("text").mapInArrow(_anchor_counts(length, gram), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = written(counts.where("n > 1"), "repeated")
    size = repeated.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    shared = spark.sparkContext.broadcast(_bloom(repeated, size.anchors))
    hot = _hot(repeated, size.rows, parts)
    found = own.mapInArrow(_run_rows(length, gram, shared), "anchor bigint, run bigint, doc bigint, key bigint, start bigint")
    suspect = written(_salted(found, hot).join(_copied(repeated, hot), ["anchor", "salt"], "left_semi").drop("salt"), "suspects")
    first = suspect.groupBy("anchor", "run").agg(least_place)
    first = written(first.select("anchor", "run", "p.doc", "p.key", "p.start"), "runs")
    several = written(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hot = _hot(several, several.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first().rows, parts)
    wanted = _salted(first, hot).join(_copied(several, hot), ["anchor", "salt"], "left_semi").groupBy("doc", "key").agg(F.collect_list("start").alias("starts"))
    suffixes = own.join(wanted, ["doc", "key"]).mapInArrow(_suffix_rows(length, gram), "suffix binary, before binary, doc bigint, key bigint, start bigint")
    suffixes = written(suffixes, "suffixes")
    buckets = max(parts, -(-suffixes.count() // 20_000))
    ranged = suffixes.repartitionByRange(buckets, "suffix", "doc", "key", "start")
    local = written(ranged.mapInArrow(_sorted_bucket(length, gram), "border boolean, gram binary, doc bigint, key bigint, start bigint"), "sorted")
    border = local.where("border")
    least = border.groupBy("gram").agg(least_place)
    lost = border.select("doc", "key", "start").exceptAll(least.select("p.doc", "p.key", "p.start"))
    again = local.where("not border").select("doc", "key", "start").unionByName(lost)
    mark = lambda df, kind: df.select("doc", "key", (F.col("start") * 4 + kind).alias("mark"))
    marks = mark(suspect, 0).unionByName(mark(first, 1)).unionByName(mark(again, 2))
    by_doc = marks.groupBy("doc", "key").agg(F.collect_list("mark").alias("marks"))
    joined = rows.join(by_doc, ["doc", "key"], "left").select(*carry, "text", "marks")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType([joined.schema[c] for c in carry] + StructType.fromDDL(RESULT).fields)
    release(spark)
    return joined.mapInArrow(_cut_rows(to_arrow_schema(kinds), length, gram, keep_text), kinds)


def dedup_documents(docs: DataFrame, length: int = 100) -> DataFrame:
    """Documents, all with their columns, without repeated passages; n_chars (where there is one) follows; documents left without a word go.

    Null texts stay null and empty ones empty, both stay; rows that repeat id and text each keep what their document
    keeps; an empty table stays empty.  No other column is read or changed, whatever its name.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))  # the text is carried once
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text", rest.alias("row"))
    out = _removed(rows, ["row"], length, True, GRAM)
    out = out.where(F.col("kept_text").rlike(r"\S") | (F.col("n_removed") == 0))
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
