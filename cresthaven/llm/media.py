"""Interleaved document sequences: text and media references in reading order, payloads resolved by digest.

HTML is parsed into an ordered array of structs: a text item, or a media item with the payload's sha256 digest and its
caption.  A media table holds each payload once, by digest; a digest join resolves every reference, and the sequences
are put together again by position, so text, media and captions stay aligned.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, utf8, written

ITEM = "struct<position:int,kind:string,text:string,digest:string>"
STORED = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
UNIT = 64  # payloads are padded with zero bytes to a positive multiple of this
RATE = 8000
LEAST_HOT = 100  # a digest with fewer references is never hot

_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_MEDIA = {"img", "audio", "video", "source"}


def sequence(page: str) -> list[dict]:
    """The ordered items of a page.  A reference is a media element whose src is ``sha256:<hex>``; its caption is the alt text or the figcaption of its figure."""
    items: list[dict] = []
    at, caption, figure = 0, None, None

    def add(kind, text, digest):
        items.append({"position": len(items), "kind": kind, "text": text, "digest": digest})

    def say(raw):
        nonlocal caption
        text = " ".join(html.unescape(raw).split())
        if caption is not None:
            caption = f"{caption} {text}".strip()
        elif text:
            add("text", text, None)

    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        closing, tag = m[2], (m[3] or "").lower()
        if tag in _MEDIA and not closing:
            attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            if attributes.get("src", "").startswith("sha256:"):
                add("media", attributes.get("alt"), attributes["src"][7:])
        elif tag == "figure":
            figure = None if closing else len(items)
        elif tag == "figcaption":
            if not closing:
                caption = ""
            elif caption is not None:
                for i in items[figure or 0 :]:
                    if i["kind"] == "media" and figure is not None:
                        i["text"] = caption
                caption = None
    say(page[at:])
    return items


def wav(payload: bytes) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    pad = b"\0" * (len(payload) % 2)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def samples(stored: bytes) -> bytes:
    """The samples of a RIFF/WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(raw: bytes) -> bytes:
    return raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT))


def feature(payload: bytes) -> str:
    """Mean, root mean square about 128 and crossings of 128 of the samples."""
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    square = (np.bincount(x, minlength=256) * (np.arange(256) - 128.0) ** 2).sum() / len(x)
    return f"mean={x.mean():.4f};rms={square**0.5:.4f};crossings={int((high[1:] != high[:-1]).sum())}"


def _media_rows(batches):
    schema = pa.schema([("digest", pa.string()), ("media", pa.binary())])
    for b in batches:
        payloads = b.column("payload")
        for at in range(0, len(payloads), 256):
            raws = [x or b"" for x in payloads.slice(at, 256).to_pylist()]
            yield batch(schema, [hashlib.sha256(x).hexdigest() for x in raws], [wav(padded(x)) for x in raws])


def _read_rows(keep: bool):
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)) + [("media", pa.binary())] * keep)

    def run(batches):
        for b in batches:
            digests, stored = b.column("digest"), b.column("media")
            for at in range(0, len(stored), 256):
                out: list[list] = [[] for _ in schema]
                for digest, media in zip(digests.slice(at, 256).to_pylist(), stored.slice(at, 256).to_pylist()):
                    back = samples(media)
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    row = [digest, len(back), sha(back), zlib.crc32(back[-UNIT:]), len(media), sha(media), feature(back)]
                    for c, v in zip(out, row + [media] * keep):
                        c.append(v)
                yield batch(schema, *out)

    return run


def store_media(payloads: DataFrame, keep: bool = True) -> DataFrame:
    """(payload: binary) -> a row per different payload: digest, what is computed from the stored bytes, and ``media`` (the stored bytes) if ``keep``.

    Payloads are padded and written as 8-bit samples to a table (digest, media) in the shared folder; all other columns
    come from the bytes read back from it.  Null counts as empty.  Copies of a payload are stored as often as they
    come, so that its bytes are not shuffled; of what is read, one row per digest is kept, merged before the shuffle.
    """
    ddl = STORED + (", media binary" if keep else "")
    stored = written(payloads.select("payload").mapInArrow(_media_rows, "digest string, media binary"), "media")
    rows = stored.mapInArrow(_read_rows(keep), ddl)
    rest = [c for c in rows.columns if c != "digest"]
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rest))


def _sequence_rows(batches):
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())])
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(item))])
    for b in batches:
        keys, pages = b.column("key"), b.column("html")
        for at in range(0, len(pages), 256):
            yield batch(schema, keys.slice(at, 256), [sequence(x or "") for x in pages.slice(at, 256).to_pylist()])


def interleave(pages: DataFrame) -> DataFrame:
    """(key: bigint, html: string) -> (key, items: array of position, kind, text, digest); null or empty html has no items."""
    return pages.select("key", "html").mapInArrow(_sequence_rows, f"key bigint, items array<{ITEM}>")


def references(sequences: DataFrame) -> DataFrame:
    """(key, items) -> a row per media item: key, sequence (a number of its own for every row that came), n_items, text_chars (code points of the text items), position, caption, digest."""
    numbered = sequences.select("key", F.monotonically_increasing_id().alias("sequence"), F.size("items").alias("n_items"), F.aggregate("items", F.lit(0).cast("bigint"), lambda n, i: n + F.when(i.kind == "text", F.length(i.text)).otherwise(0)).alias("text_chars"), F.filter("items", lambda i: i.kind == "media").alias("items"))
    refs = numbered.select("key", "sequence", "n_items", "text_chars", F.explode("items").alias("i"))
    return refs.select("key", "sequence", "n_items", "text_chars", "i.position", F.col("i.text").alias("caption"), "i.digest")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(key, items), (digest, ...) -> a row per media item: the columns of ``references`` and the media columns.

    A reference whose digest is not stored keeps its row, with nulls.  A digest with more than a partition's share of
    the references (so there are at most as many of them as partitions) is hot: its references are dealt over salts,
    its media row is copied to each salt.  All other references join by the digest alone.
    """
    spark = sequences.sparkSession
    refs = written(references(sequences), "references")
    columns = [*refs.columns, *(c for c in media.columns if c != "digest")]
    share = max(refs.count() // int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_HOT)
    hot = written(refs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("_salts")), "hot-digests")
    if hot.isEmpty():
        return refs.join(media, "digest", "left").select(columns)
    tagged = refs.join(F.broadcast(hot), "digest", "left")
    cold = tagged.where("_salts is null").join(media, "digest", "left").select(columns)
    copies = media.join(F.broadcast(hot), "digest").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    # the row number within a partition of the written table deals even references that repeat in every column
    dealt = tagged.where("_salts is not null").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), "_salts").cast("int"))
    return cold.unionByName(dealt.join(copies, ["digest", "_salt"], "left").select(columns))


def page_of(raw: bytes, text: str) -> str:
    """A document as a page: its first line, its bytes as one media payload with their number as caption, its other lines, and the payload once more."""
    digest = hashlib.sha256(raw).hexdigest()
    first, _, rest = text.partition("\n")
    said = lambda t: f"<p>{html.escape(t)}</p>" if t else ""
    return f'{said(first)}<figure><img src="sha256:{digest}"><figcaption>{len(raw)}</figcaption></figure>{said(rest)}<audio src="sha256:{digest}" alt="{len(raw)} bytes"></audio>'


def _document_page(batches):
    schema = pa.schema([("key", pa.int64()), ("html", pa.string())])
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        for at in range(0, len(texts), 256):
            raws = utf8(texts.slice(at, 256))
            yield batch(schema, ids.slice(at, 256), [page_of(r, t or "") for r, t in zip(raws, texts.slice(at, 256).to_pylist())])


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> a row per row: doc_id, n_bytes, the stored payload's columns, n_items, text_chars, positions, captions.

    Each document becomes a page: its first line, a figure that refers to its text's bytes by digest and carries their
    number as the caption, its other lines, and a second reference.  Sequences, media table and digest join are the
    general ones; both references are resolved and put together again by position.  n_bytes is the first one's caption,
    text_chars counts the code points of the sequence's text items (white space as one space).  Null text counts as
    empty (64 zero bytes are stored); ids may be null or repeat; extra columns are ignored; no documents, no rows.
    """
    pages = docs.select("doc_id", "text").mapInArrow(_document_page, "key bigint, html string")
    media = store_media(docs.select(F.col("text").cast("binary").alias("payload")), keep=False)
    values = [c for c in media.columns if c != "digest"]
    out = resolve(interleave(pages), media)
    order = F.sort_array(F.collect_list(F.struct("position", "caption", "digest")))
    whole = out.groupBy("sequence", "key", "n_items", "text_chars").agg(order.alias("refs"), *(F.first(c).alias(c) for c in values))
    one = F.size(F.array_distinct(F.transform("refs", lambda r: r.digest))) == 1
    names = lambda f: F.array_join(F.transform("refs", f), ",")
    return whole.select(F.col("key").alias("doc_id"), F.get("refs", F.lit(0)).caption.cast("bigint").alias("n_bytes"), *(F.when(one, F.col(c)).alias(c) for c in values), "n_items", "text_chars", names(lambda r: r.position.cast("string")).alias("positions"), names(lambda r: r.caption).alias("captions"))
