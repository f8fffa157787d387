"""Benchmark decontamination with DataFrame functions only.

A document is searched for windows of an item's size that are near copies of it.
1. Words are runs of letters and digits, lower-cased; shingles are five words (all words where an item has fewer).
   Proved prefilter, by item size and not by item: a window can only reach the similarity if enough of its shingles
   are shingles of items of its size; the starts for which that holds follow from the sorted places of the document's
   shingles that such items have.  Nothing else is dropped.
2. Each such window gets a 64-bit SimHash.  The index of the items has a row (size, block, value) for each of the eight
   8-bit blocks of an item's fingerprint and each value within two bits of the block's own.  Of at most 23 differing
   bits some block has two or fewer, so a join of the window's eight blocks with the index finds every item of the
   window's size within radius 23.  Which item a window is compared with comes from the index alone.
3. What is found is verified by the exact weighted similarity of the shingles (weight: occurrences): the sum of the
   lesser weights over the sum of the greater ones.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, unwrapped, wrapped, written

WIDTH, BLOCKS, RADIUS = 5, 8, 23
BROADCAST_ROWS = 1_000_000  # rows of item shingles, of the index, and of leaking documents up to which a side is broadcast
CHUNK = 64  # window starts whose words lie in one row


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """The hashes of a word array's shingles, in order; of fewer words than ``width`` there is one shingle, of none none."""
    last = F.greatest(F.size(w) - width, F.lit(0))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """The majority fingerprint of an array of 64-bit hashes."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    share = lambda b: F.size(F.filter(h, lambda x: F.call_function("shiftright", x, b).bitwiseAND(one) == one))
    bit = lambda b: F.when(share(b) * 2 > F.size(h), F.call_function("shiftleft", one, b)).otherwise(zero)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, b: acc.bitwiseOR(bit(b)))


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255).cast("bigint")).cast("int")


def blocks(fp: Column) -> Column:
    """Eight (block, value) keys, as block * 256 + value."""
    return F.array(*(block(fp, k) + 256 * k for k in range(BLOCKS)))


def neighbours(keys: Column) -> Column:
    """All keys whose value differs in at most two bits from one of ``keys``."""
    flips = [0, *(1 << i for i in range(8)), *((1 << i) | (1 << j) for i, j in combinations(range(8), 2))]
    return F.flatten(F.transform(keys, lambda k: F.transform(F.array(*map(F.lit, flips)), lambda f: k.bitwiseXOR(f))))


def first_block(differing: Column) -> Column:
    """The first block in which at most two of the differing bits lie: a pair that meets in several blocks counts once."""
    out = F.lit(None).cast("int")
    for k in reversed(range(BLOCKS)):
        out = F.when(F.bit_count(block(differing, k)) <= 2, k).otherwise(out)
    return out


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as bags."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return both / (F.size(a) + F.size(b) - both)


def texts(w: Column, width: Column) -> Column:
    """A word array's shingles as texts."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))


def items_of(benchmark: DataFrame) -> DataFrame:
    """A row for each item with a word; of rows that share an id each is an item of its own, told apart by its text."""
    w = benchmark.select("item_id", F.xxhash64("text").alias("item_key"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    w = w.dropDuplicates(["item_id", "item_key"]).withColumns({"width": F.least(F.size("item_words"), F.lit(WIDTH)), "n_words": F.size("item_words")})
    w = w.withColumn("item_hashes", shingles(F.col("item_words"))).withColumn("item_texts", texts(F.col("item_words"), F.col("width")))
    return w.withColumn("item_fp", simhash(F.col("item_hashes"))).drop("item_words")


def index_of(items: DataFrame) -> DataFrame:
    """The multi-index: (n_words, block_key, item_id, item_key, item_fp), a row for each block key within two bits of the item's own."""
    return items.select("n_words", F.explode(F.array_distinct(neighbours(blocks(F.col("item_fp"))))).alias("block_key"), "item_id", "item_key", "item_fp")


def _side(df: DataFrame) -> DataFrame:
    """A written side of a join: broadcast while its rows are few; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(hashed: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc, key, w) -> (doc, key, n_words, width, start): the windows that pass the prefilter for some item size."""
    sizes = items.groupBy("n_words", "width").agg(F.min(F.size("item_hashes")).alias("m"))
    place = written(items.select("n_words", "width", F.size("item_hashes").alias("m"), F.explode("item_hashes").alias("hash")).distinct(), "item-shingles")
    side = _side(place)
    widths = sorted(r.width for r in sizes.select("width").distinct().collect())  # at most WIDTH values
    hits = None
    for width in widths or [WIDTH]:
        each = hashed.select("doc", "key", F.posexplode(shingles(F.col("w"), width)).alias("at", "hash"))
        found = each.join(side.where(F.col("width") == width), "hash").select("doc", "key", "n_words", "width", "m", "at")
        hits = found if hits is None else hits.unionByName(found)
    by_size = hits.groupBy("doc", "key", "n_words", "width", "m").agg(F.sort_array(F.collect_set("at")).alias("p"))
    by_size = by_size.withColumn("need", F.ceil(F.lit(least) * F.col("m") - F.lit(1e-9)).cast("int")).where(F.size("p") >= F.col("need"))
    spans = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.struct(F.greatest(F.get("p", i + F.col("need") - 1) - F.col("m") + 1, F.lit(0)).alias("lo"), F.get("p", i).alias("hi")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s.lo <= s.hi), lambda s: F.sequence(s.lo, s.hi))))
    return by_size.select("doc", "key", "n_words", "width", F.explode(starts).alias("start"))


def fingerprints(found: DataFrame, one: DataFrame) -> DataFrame:
    """(doc, key, n_words, width, start), (doc, key, w) -> the same with fp, the window's SimHash; a row holds ``CHUNK`` starts' words, not a document's."""
    n, w, width = F.col("n_words"), F.col("w"), F.col("width")
    placed = found.join(one, ["doc", "key"]).select("doc", "key", "n_words", "width", F.least("start", F.greatest(F.size(w) - n, F.lit(0))).alias("start"), "w")
    chunk = F.floor(F.col("start") / CHUNK).cast("int")
    starts = placed.select("doc", "key", "n_words", "width", chunk.alias("chunk"), "start").groupBy("doc", "key", "n_words", "width", "chunk").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    cut = starts.join(one, ["doc", "key"]).select("doc", "key", "n_words", "width", "starts", (F.col("chunk") * CHUNK).alias("base"), F.slice(w, F.col("chunk") * CHUNK + 1, n + CHUNK).alias("part"))
    h = shingles(F.col("part"), WIDTH)
    for k in range(1, WIDTH):
        h = F.when(width == k, shingles(F.col("part"), k)).otherwise(h)
    cut = cut.withColumn("h", h)
    cuts = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice(F.col("h"), s - F.col("base") + 1, n - width + 1).alias("h")))
    prints = F.transform(cuts, lambda x: F.struct(x.start.alias("start"), simhash(x.h).alias("fp")))
    return cut.select("doc", "key", "n_words", "width", F.explode(prints).alias("x")).select("doc", "key", "n_words", "width", "x.start", "x.fp")


def near_items(prints: DataFrame, index: DataFrame) -> DataFrame:
    """Windows with the items of their size within the radius, found through the index: (..., start, item_id, item_key, hamming)."""
    keyed = prints.withColumn("block_key", F.explode(blocks(F.col("fp"))))
    met = keyed.join(index, ["n_words", "block_key"])
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = met.where((F.bit_count(differing) <= RADIUS) & (first_block(differing) == F.floor(F.col("block_key") / 256)))
    return met.select("doc", "key", "n_words", "width", "start", "item_id", "item_key", F.bit_count(differing).cast("int").alias("hamming"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) -> doc_id, item_id, start (word), n_words, hamming, similarity.

    A row for each document and item of which some window reaches ``least``: the most similar window, the first of
    equal ones.  Null or empty texts and items match nothing; null ids are kept.  Rows that repeat id and text give
    one row; rows that share just an id count separately.  Extra columns are ignored; an empty table gives no rows.
    """
    items = written(items_of(benchmark), "items")
    index = _side(written(index_of(items), "item-index"))
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    hashed = own.select("doc", "key", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    found = written(windows(hashed, items, least).distinct(), "windows")
    # the few documents with such a window are read again for their words
    few = _side(written(found.select("doc", "key").distinct(), "ids"))
    one = own.join(few, ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
    one = written(one.select("doc", "key", words(F.col("text")).alias("w")), "words")
    near = written(near_items(fingerprints(found, one), index), "near")
    shown = _side(items.select("item_id", "item_key", "item_texts"))
    same = near.item_id.eqNullSafe(shown.item_id) & (near.item_key == shown.item_key)
    row = near.join(one, ["doc", "key"]).join(shown, same).select("doc", "key", near.item_id, near.item_key, "n_words", "start", "hamming", "item_texts", texts(F.slice("w", F.col("start") + 1, F.col("n_words")), F.col("width")).alias("window"))
    alike = similarity(F.col("window"), F.col("item_texts"))
    best = row.groupBy("doc", "key", "item_id", "item_key", "n_words").agg(F.max(F.struct(alike.alias("similarity"), (-F.col("start")).alias("before"), "hamming")).alias("best"))
    return best.where(F.col("best.similarity") >= least).select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "item_id", (-F.col("best.before")).alias("start"), "n_words", "best.hamming", "best.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no benchmark item is found.

    Null and empty texts hold nothing and stay; of rows that share an id all go if one leaks.  Rows that repeat stay as
    often as they come; no column of ``docs`` is read but doc_id and text, whatever the others are called.
    """
    found = leaks(docs, benchmark, least).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("leak")).distinct()
    rows = wrapped(docs, id=F.coalesce("doc_id", F.lit(NO_ID)))
    gone = _side(written(found, "leaks"))
    return unwrapped(rows.join(gone, rows["id"] == gone["leak"], "left_anti"), docs)
