"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Tokens are words and one end for each text; the history of the first word is the beginning.  Discounts D1, D2, D3+
come from the counts of counts of each level (Chen and Goodman).

    p(w | v) = (c(v,w) - D(c(v,w))) / c(v) + lambda(v) * p(w)
    p(w)     = (n(w) - D'(n(w))) / n + lambda' / (V + 1)

where n(w) is the number of different histories of w (lower order), and V + 1 leaves room for the unknown word.  A
history never seen passes all its mass to p(w).

1. Tasks count hashed words of their rows, Spark adds the counts up; words get dense numbers by hash range.
2. Tasks count pairs of word numbers, Spark deals them by history, those of a history with over a task's share of the
   tokens by the word that follows too; each task adds its pairs up and writes them as a sorted array.  What follows of histories and words goes into one more sum.
3. Everything lies as sorted arrays in the shared folder.  Tasks map these files into memory and look up by binary
   search, so that neither the driver nor a worker holds the model.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, held_out, own_dir, release, written

END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))  # no word holds white space
COUNTS = pa.schema([("hash", pa.int64()), ("c", pa.int64())])
PAIRS = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("c", pa.int64())])
STATS = pa.schema([("id", pa.int64()), ("n", pa.int64()), *((f"n{k}", pa.int64()) for k in (1, 2, 3, 4)), ("more", pa.int64())])
FILES = pa.schema([("low", pa.int64()), ("high", pa.int64()), ("name", pa.string())])
IDS = [("key", "<u8"), ("id", "<i8")]
WORDS = [("key", "<u8"), ("count", "<i8"), ("lower", "<f8"), ("backoff", "<f8")]
BIGRAMS = [("key", "<u8"), ("c", "<u4")]
WIDE = [("key", "<u8"), ("c", "<u8")]  # of files, named w..., with a count beyond 32 bits
LEAST_HOT = 100_000  # a word with fewer tokens is no hot history
MOST_WORDS = 2**32 - 2  # numbers of words fit in half of a pair's key
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _slices(column: pa.Array, most: int = 4 << 20):
    """Slices of at most ``most`` bytes of text, or of one text that is longer."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted XXH64 values (seed 42) of the different tokens, the place among them of every token, ends included; the place after each text's end).

    Arrow lower-cases A-Z, splits at ASCII white space and finds the different words; only these are hashed one by one.
    """
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    lists = pc.ascii_split_whitespace(low)
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    empty = pc.equal(low, "").to_numpy(zero_copy_only=False).astype(np.int64)  # an empty text has one word, the empty one
    if empty.any():
        codes = codes[codes != words.index(b"")]
    digest = xxhash.xxh64_intdigest
    kinds, place = np.unique(np.array([*(digest(w, 42) for w in words), int(END)], np.uint64), return_inverse=True)
    ends = np.cumsum(np.diff(offsets) - empty + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last], out[~last] = place[len(words)], place[codes]
    if empty.any():  # the empty word is no token
        used = np.unique(out)
        kinds, out = kinds[used], np.searchsorted(used, out)
    return kinds, out, ends


def _combine(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1)
    return k[first], np.add.reduceat(c, first)


class Counter:
    """Adds up keys in numpy; hands sums over when they hold ``most`` keys, which bounds memory."""

    def __init__(self, most: int = 1 << 20):
        self.keys, self.counts, self.n, self.most = [], [], 0, most

    def add(self, k: np.ndarray, c: np.ndarray | None = None):
        """Keys, or different keys with their counts."""
        if c is None:
            k, c = np.unique(k, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.n += len(k)
        if self.n > self.most:
            k, c = _combine(self.keys, self.counts)
            if len(k) * 2 > self.most:
                self.keys, self.counts, self.n = [], [], 0
                return k, c
            self.keys, self.counts, self.n = [k], [c], len(k)
        return None

    def rest(self):
        return _combine(self.keys, self.counts) if self.keys else None


def _lean(run):
    """The task; at its end the worker, which lives on beside those of later stages, gives back what its allocators keep."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return task


def _rows(columns, most: int = 1 << 16):
    """Columns in slices of at most ``most`` rows: the JVM holds a whole batch outside its heap."""
    for at in range(0, len(columns[0]), most):
        yield [c[at : at + most] for c in columns]


def _word_counts(batches):
    counter = Counter()
    for b in batches:
        for _, texts in _slices(b.column("text")):
            kinds, back, _ = tokens(texts)
            if full := counter.add(kinds, np.bincount(back, minlength=len(kinds))):
                yield from (batch(COUNTS, k.view(np.int64), c) for k, c in _rows(full))
    if full := counter.rest():
        yield from (batch(COUNTS, k.view(np.int64), c) for k, c in _rows(full))


def _file_system(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _write(folder: str, columns: list[np.ndarray], prefix: str = "") -> pa.RecordBatch:
    """Write arrays one after the other, keys (sorted) first; the file's name appears when it is whole, so a task that is run again does no harm."""
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    name = prefix + uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/_{name}") as f:
        for c in columns:
            f.write(memoryview(np.ascontiguousarray(c)).cast("B"))
    fs.move(f"{path}/_{name}", f"{path}/{name}")
    low, high = columns[0][[0, -1]].view(np.int64).tolist()
    return batch(FILES, [low], [high], [name])


def _pieces(parts: np.ndarray):
    """(begin, end) of each value in a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def _writer(folder: str, kind: list[tuple[str, str]]):
    """Write each partition's rows (columns as in ``kind``, keys as signed) sorted by key, a file for each range ``part``."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        key, parts = t["key"].to_numpy().view(np.uint64), t["part"].to_numpy()
        order = np.lexsort((key, parts))
        columns = [key[order], *(t[n].to_numpy()[order].astype(of) for n, of in kind[1:])]
        for s, e in _pieces(parts[order]):
            yield _write(folder, [c[s:e] for c in columns])

    return run


def _dealt(rows: DataFrame, part: str, parts: int) -> DataFrame:
    """Rows dealt so that range k goes to task k: by a number that Spark's hash sends there."""
    spark = rows.sparkSession
    found = spark.range(parts * 32).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()  # a row for each task
    number = {r.p: r.id for r in found}
    table = F.lit([number.get(k, k) for k in range(parts)]).cast("array<bigint>")
    return rows.repartition(parts, F.element_at(table, (F.col(part) + 1).cast("int")))


def _files(rows) -> list[tuple[int, int, str]]:
    """(least key, greatest key, name) of the files, in order: a row for each partition."""
    return sorted((f.low % 2**64, f.high % 2**64, f.name) for f in rows)


def _by_range(rows: DataFrame, part: Column, folder: str, kind) -> list[tuple[int, int, str]]:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _files(_dealt(rows.withColumn("part", part), "part", parts).mapInArrow(_lean(_writer(folder, kind)), "low bigint, high bigint, name string").collect())


_mapped: dict[str, dict[str, np.ndarray]] = {}


def _map(folder: str, name: str, kind) -> dict[str, np.ndarray]:
    key = f"{folder}/{name}"
    if key not in _mapped:
        fs, path = _file_system(folder)
        local = f"{path}/{name}"
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):  # a store that is no mounted folder: a worker's own copy
            handle, local = tempfile.mkstemp()
            with fs.open_input_stream(f"{path}/{name}") as f, os.fdopen(handle, "wb") as out:
                while piece := f.read(1 << 24):
                    out.write(piece)
        rows = os.path.getsize(local) // np.dtype(kind).itemsize
        at, columns = 0, {}
        for field, of in kind:
            columns[field] = np.memmap(local, of, "r", at, (rows,))
            at += rows * np.dtype(of).itemsize
        _mapped[key] = columns
    return _mapped[key]


def look_up(folder: str, files: list, kind, wanted: np.ndarray, fields: list[str], missing: int = 0) -> list[np.ndarray]:
    """For sorted distinct keys the fields' values, ``missing`` where there is none."""
    out = [np.full(len(wanted), missing, dict(WIDE if kind is BIGRAMS else kind)[f]) for f in fields]
    for low, high, name in files:
        lo, hi = np.searchsorted(wanted, np.uint64(low)), np.searchsorted(wanted, np.uint64(high), side="right")
        if lo == hi:
            continue
        a = _map(folder, name, WIDE if name.startswith("w") else kind)
        keys = a["key"]
        at = np.minimum(np.searchsorted(keys, wanted[lo:hi]), len(keys) - 1)
        known = keys[at] == wanted[lo:hi]
        for o, f in zip(out, fields):
            o[lo:hi][known] = a[f][at[known]]
    return out


def _histories(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history of each token, 0 for the beginning; starts of the texts)."""
    starts = np.append(0, ends[:-1])
    v = np.empty_like(ids)
    v[1:] = ids[:-1]
    v[starts] = 0
    return v, starts


def _pair_counts(folder: str, files: list):
    def run(batches):
        counter = Counter()

        def rows(full):
            for k, c in _rows(full):
                yield batch(PAIRS, (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64), c)

        for b in batches:
            for _, texts in _slices(b.column("text")):
                kinds, back, ends = tokens(texts)
                ids = look_up(folder, files, IDS, kinds, ["id"])[0][back]
                v, _ = _histories(ids, ends)
                if full := counter.add(v.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)):
                    yield from rows(full)
        if full := counter.rest():
            yield from rows(full)

    return run


class Ranges:
    """Which range a pair belongs to: ranges of histories, and for each hot history ranges of its own of what follows."""

    def __init__(self, width: int, words: int, parts: int, hot: list[tuple[int, int]]):
        """``hot``: (history, number of its ranges), at most as many as ``parts``."""
        self.width, self.words, self.hot = width, words, sorted(hot)
        sizes = np.array([n for _, n in self.hot], np.int64)
        self.ids, self.sizes, self.first = np.array([i for i, _ in self.hot], np.int64), sizes, parts + np.cumsum(sizes) - sizes
        self.parts = parts + int(sizes.sum())

    def of(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = v // self.width
        if self.hot:
            k = np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1)
            own = self.ids[k] == v
            out[own] = self.first[k[own]] + w[own] * self.sizes[k[own]] // (self.words + 1)
        return out

    def dealt(self, pairs: DataFrame) -> DataFrame:
        part = F.floor(F.col("v") / self.width)
        if self.hot:
            rows = [(int(i), int(f), int(n)) for i, f, n in zip(self.ids, self.first, self.sizes)]
            hot = F.broadcast(pairs.sparkSession.createDataFrame(rows, "v bigint, _first bigint, _n bigint"))
            pairs = pairs.join(hot, "v", "left")
            part = F.coalesce(F.col("_first") + F.expr(f"w * _n div {self.words + 1}"), part)
        return _dealt(pairs.select("v", "w", "c", part.cast("int").alias("part")), "part", self.parts)


def _pair_files(folder: str, ranges: Ranges):
    """Add up a partition's pairs, write them, and pass on: of each history how many pairs it has once, twice, ..., of each word its histories."""
    schema = pa.schema([*STATS, *FILES])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        key, c = _combine([t["v"].to_numpy().astype(np.uint64) << np.uint64(32) | t["w"].to_numpy().astype(np.uint64)], [t["c"].to_numpy()])
        del t
        v, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(v[1:] != v[:-1]) + 1)
        total = lambda x: np.add.reduceat(x.astype(np.int64), first)
        zero = np.zeros(len(first), np.int64)
        blank = lambda n, kind: pa.nulls(n, kind)
        for part in _rows([v[first], zero, *(total(c == k) for k in (1, 2, 3, 4)), total(c > 4)]):
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in part), *(blank(len(part[0]), f.type) for f in FILES)], schema=schema)
        word, n = np.unique(w, return_counts=True)
        for part in _rows([word, n]):
            zero = np.zeros(len(part[0]), np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in part), *(pa.array(zero) for _ in range(5)), *(blank(len(zero), f.type) for f in FILES)], schema=schema)
        for s, e in _pieces(ranges.of(v, w)):
            wide = int(c[s:e].max()) >= 2**32
            file = _write(folder, [key[s:e], c[s:e].astype("<u8" if wide else "<u4")], "w" if wide else "")
            yield pa.RecordBatch.from_arrays([*(blank(1, pa.int64()) for _ in STATS), *file.columns], schema=schema)

    return run


def discounts(n1, n2, n3, n4) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; half of 1, 2, 3 where these are missing or leave the allowed range."""
    n = [n1 or 0, n2 or 0, n3 or 0, n4 or 0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] else 0 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), found))


class Model:
    """The written model: file names and a few numbers; workers map the files."""

    def __init__(self, folder: str, ids: list, words: list, pairs: list, train_tokens: int, vocabulary: int, floor: float, begin: float, documents: int, high: tuple):
        self.folder, self.ids, self.words, self.pairs = folder, ids, words, pairs
        self.train_tokens, self.vocabulary, self.floor, self.begin, self.documents, self.high = train_tokens, vocabulary, floor, begin, documents, high


def train(docs: DataFrame) -> Model:
    """Count and write the model of all texts of ``docs`` (text); null counts as empty, no text at all gives an empty model.

    Word numbers have 32 bits: over ``MOST_WORDS`` different words are refused.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{own_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    texts = docs.select("text")
    counted = texts.mapInArrow(_lean(_word_counts), "hash bigint, c bigint").groupBy("hash").agg(F.sum("c").alias("count"))
    counted = written(counted.withColumn("part", F.floor(F.shiftrightunsigned("hash", 40) * F.lit(parts) / F.lit(float(1 << 24))).cast("int")), "words")
    # dense numbers from 1: ranges of the hash in order, then the order within a range;
    per = counted.groupBy("part").agg(F.count("*").alias("rows"))
    before = per.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    numbered = counted.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("hash")))
    numbered = written(numbered.join(F.broadcast(before), "part").select("hash", "count", "part", (F.col("before") + F.col("place")).alias("id")), "numbers")
    ids = _by_range(numbered.select(F.col("hash").alias("key"), "id", "part"), F.col("part"), folder, IDS)
    pairs = texts.mapInArrow(_lean(_pair_counts(folder, ids)), "v bigint, w bigint, c bigint")
    top = counted.agg(F.sum("count").alias("tokens"), F.count("*").alias("v")).first()
    vocabulary = top.v or 0
    if vocabulary > MOST_WORDS:
        raise ValueError(f"{vocabulary} different words; at most {MOST_WORDS} have numbers")
    width = vocabulary // parts + 1  # numbers 0 (the beginning) to vocabulary, in ``parts`` ranges
    # the beginning has as many tokens as there are texts
    share = max((top.tokens or 0) // parts, LEAST_HOT)
    hot = [(r.id, -(-r["count"] // share)) for r in numbered.where(F.col("count") > share).select("id", "count").collect()]  # at most ``parts`` rows
    begins = counted.where(F.col("hash") == F.lit(int(END.view(np.int64)))).select("count").first()
    if begins and begins[0] > share:
        hot.append((0, -(-begins[0] // share)))
    ranges = Ranges(width, vocabulary, parts, hot)
    dealt = ranges.dealt(pairs).mapInArrow(_lean(_pair_files(folder, ranges)), "id bigint, n bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint, low bigint, high bigint, name string")
    found = written(dealt, "pairs")
    files = _files(found.where("name is not null").collect())
    names = ["n", "n1", "n2", "n3", "n4", "more"]
    sums = written(found.where("name is null").groupBy("id").agg(*(F.sum(c).alias(c) for c in names)), "sums")
    all_ = sums.agg(*(F.sum(c).alias(c) for c in names), *(F.count_if(F.col("n") == k).alias(f"k{k}") for k in (1, 2, 3, 4)), F.count_if(F.col("n") > 0).alias("v")).first()
    d, low = discounts(all_.n1, all_.n2, all_.n3, all_.n4), discounts(all_.k1, all_.k2, all_.k3, all_.k4)
    n = all_.n or 1
    freed_low = (all_.k1 or 0) * low[0] + (all_.k2 or 0) * low[1] + ((all_.v or 0) - (all_.k1 or 0) - (all_.k2 or 0)) * low[2]
    floor = freed_low / n / (vocabulary + 1) if vocabulary else 1.0
    cut = F.when(F.col("n") == 1, low[0]).when(F.col("n") == 2, low[1]).otherwise(low[2])
    freed = F.col("n1") * d[0] + F.col("n2") * d[1] + (F.col("n3") + F.col("n4") + F.col("more")) * d[2]
    documents = begins[0] if begins else 0
    start = sums.where("id = 0").select(freed.alias("b")).first()
    words = numbered.join(sums, "id").select(F.col("id").alias("key"), "count", ((F.col("n") - cut) / n + floor).alias("lower"), F.when(F.col("n1") + F.col("n2") + F.col("n3") + F.col("n4") + F.col("more") > 0, freed / F.col("count")).otherwise(1.0).alias("backoff"))
    word_files = _by_range(words, F.floor(F.col("key") / width).cast("int"), folder, WORDS)
    release(spark)
    return Model(folder, ids, word_files, files, int(top.tokens or 0), int(vocabulary), floor, start.b / documents if start and documents else 1.0, int(documents), d)


def _score_rows(model: Model):
    def run(batches):
        base = np.log10(model.train_tokens + model.vocabulary + 1)
        d = np.array([0.0, *model.high])
        for b in batches:
            for at, texts in _slices(b.column("text")):
                kinds, back, ends = tokens(texts)
                kind_ids = look_up(model.folder, model.ids, IDS, kinds, ["id"])[0]
                order = np.argsort(kind_ids)
                count, lower, backoff = (np.zeros(len(kinds), x) for x in ("i8", "f8", "f8"))
                found = look_up(model.folder, model.words, WORDS, kind_ids[order].astype(np.uint64), ["count", "lower", "backoff"])
                for x, y in zip((count, lower, backoff), found):
                    x[order] = y
                known = kind_ids > 0
                lower[~known], backoff[~known] = model.floor, 1.0
                ids = kind_ids[back]
                v, starts = _histories(ids, ends)
                after, seen = backoff[back], count[back].astype(np.float64)
                weight, total = np.empty_like(after), np.empty_like(seen)
                weight[1:], total[1:] = after[:-1], seen[:-1]
                weight[starts], total[starts] = model.begin, model.documents
                fresh = (ids == 0) | ((v == 0) & (np.arange(len(v)) != np.repeat(starts, ends - starts)))  # an unknown word on either side: no such pair
                pair, which = np.unique(np.where(fresh, 0, v.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)), return_inverse=True)
                c = look_up(model.folder, model.pairs, BIGRAMS, pair, ["c"])[0][which].astype(np.int64)
                high = (c - d[np.minimum(c, 3)]) / np.maximum(total, 1)
                log = np.log10(high + weight * lower[back])
                plain = (np.log10(count + 1.0) - base)[back]
                add = lambda x: np.add.reduceat(x, starts)
                yield batch(RESULT, b.column("doc_id").slice(at, len(texts)), ends - starts, add(known[back].astype(np.int64)), add(plain), add(log))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> a row per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity.

    Null text counts as empty: one token, the end.  Ids may be null or repeat; extra columns are ignored.
    """
    out = docs.select("doc_id", "text").mapInArrow(_lean(_score_rows(model)), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the held-out seventh and score all."""
    test = held_out(modulus=7, remainder=2)
    model = train(docs.where(~test))
    return score(docs, model).select("doc_id", held_out(modulus=7, remainder=2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
