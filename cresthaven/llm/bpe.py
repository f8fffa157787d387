"""BPE encoding and decoding with a given tokenizers file; long unsplit text by tree concatenation.

Short pieces are encoded one by one and remembered.  A piece of over ``LONG`` symbols is cut into leaves, which are
encoded independently of each other and then joined pairwise, level by level.  At a join the last k tokens of the
left side and the first k of the right are encoded again as one window; k doubles until the window's outer tokens
agree with their neighbours on both sides: the encoding of the two tokens together is the two tokens.  A sequence all
of whose neighbours agree is the encoding of the whole, so the result is exact.

Pieces of over ``FAR`` symbols are dealt over tasks: each of their halves of halves, down to leaves of ``LEAF`` symbols,
is encoded by a task of its own, and each level's joins run in parallel too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import batch, sliced, written

LONG = 64
LEAF, FAR = 1 << 13, 1 << 15  # symbols of a task's leaf; of a piece from which on tasks share it
REMEMBERED = 200_000
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids string, decoded string"
PIECES = pa.schema([("text_key", pa.binary()), ("piece", pa.binary()), ("leaf", pa.int64()), ("ids", pa.list_(pa.int32()))])
# The normaliser of the supported tokenizer files.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

_WHITE = r"\t-\r \x85\xa0  -     　"
# Fixed value: the split pattern of the supported tokenizer files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")


def _latin() -> re.Pattern:
    """The same pattern for texts of the first 256 characters only."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^\t-\r \x85\xa0{of('L')}{of('N')}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Encodes as the tokenizers library does with the file's text ``source`` (no truncation, no padding, no special tokens added)."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if spec["pre_tokenizer"]["type"] == "Sequence" else None
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or split != SPLIT or spec["decoder"] is not None or (spec["normalizer"] or {}).get("normalizers") != NORMAL or not plain:
            raise ValueError("not a tokenizer file of the supported kind")
        self.library = Tokenizer.from_str(source)
        self.normal, self.tokenize = self.library.normalizer.normalize_str, self.library.model.tokenize
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.vocab.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.latin, self.letters = _latin(), _byte_letters()
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _ANY.findall(self.normal(text))
        return self.latin.findall(text.lower())

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE over symbol ids: the pair of least rank first, the leftmost of equal ones."""
        n, get = len(ids), self.rank.get
        ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = get((a, b))[1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if r := get((ids[i], ids[k])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := left[i]) >= 0 and (r := get((ids[h], ids[i]))):
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def symbols(self, tokens: list[int]) -> list[int]:
        """The initial symbols that the tokens are made of."""
        out, end = [], self.suffix
        for t in map(self.token.__getitem__, tokens):
            closes = bool(end) and t.endswith(end)
            body = t[: -len(end)] if closes else t
            out += [self.vocab[c] for c in body[: len(body) - closes]] + ([self.vocab[body[-1] + end]] if closes else [])
        return out

    def agree(self, a: int, b: int) -> bool:
        return self.merge(self.symbols([a, b])) == [a, b]

    def join(self, a: list[int], b: list[int], k: int = 2) -> list[int]:
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self.merge(self.symbols(a[i:] + b[:j]))
            if (i == 0 or self.agree(a[i - 1], window[0])) and (j == len(b) or self.agree(window[-1], b[j])):
                return a[:i] + window + b[j:]
            k *= 2

    def tree(self, symbols: list[int], leaf: int = LONG) -> list[int]:
        level = [self.merge(symbols[i : i + leaf]) for i in range(0, len(symbols), leaf)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def word(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return piece.encode().decode("latin-1").translate(self.letters)

    def piece(self, piece: str) -> list[int]:
        word = self.word(piece)
        if len(word) <= LONG:
            return [t.id for t in self.tokenize(word)]
        return self.tree(self.starting(word))

    def starting(self, word: str) -> list[int]:
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]

    def far(self, text: str) -> set[str]:
        """The text's pieces that tasks share."""
        parts = self.cut.split(text) if self.cut else [text]
        return {p for part in parts if part not in self.added for p in self.pieces(part) if len(p) * 4 > FAR and len(self.word(p)) > FAR}

    def know(self, piece: str, ids: list[int]) -> None:
        self.ids[piece], self.texts[piece] = " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def learn(self, pieces: list[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.texts.clear()
        for p in set(pieces):
            if p not in self.ids:
                self.know(p, self.piece(p))

    def __call__(self, text: str) -> tuple[str, str]:
        """(ids joined by one space, decoded text) of a text."""
        ids, texts = [], []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                ids.append(str(self.added[part]))
                texts.append(part)
                continue
            pieces = self.pieces(part)
            try:
                more = list(map(self.ids.__getitem__, pieces))
            except KeyError:
                self.learn(pieces)
                more = list(map(self.ids.__getitem__, pieces))
            ids += more
            texts += map(self.texts.__getitem__, pieces)
        return " ".join(ids), " ".join(texts)


_encoders: dict[str, Encoder] = {}


def _encoder(source) -> Encoder:
    text = source.value
    key = hashlib.sha256(text.encode()).hexdigest()
    return _encoders.get(key) or _encoders.setdefault(key, Encoder(text))


def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _leaf_rows(source):
    """Texts with far pieces -> these pieces' leaves, as starting symbols."""

    def run(batches):
        encode = _encoder(source)
        for b in batches:
            for text in b.column("text").to_pylist():
                for p in sorted(encode.far(text)):
                    symbols = encode.starting(encode.word(p))
                    for leaf, at in enumerate(range(0, len(symbols), LEAF)):
                        yield batch(PIECES, [_sha(text)], [_sha(p)], [leaf], [symbols[at : at + LEAF]])

    return run


def _leaves_encoded(source):
    def run(batches):
        encode = _encoder(source)
        for b in batches:
            yield batch(PIECES, *(b.column(c) for c in ("text_key", "piece", "leaf")), [encode.tree(x) for x in b.column("ids").to_pylist()])

    return run


def _joined(source):
    """(text_key, piece, leaf, left, right) -> ids of both together; right may be null."""

    def run(batches):
        encode = _encoder(source)
        for b in batches:
            sides = zip(b.column("left").to_pylist(), b.column("right").to_pylist())
            yield batch(PIECES, *(b.column(c) for c in ("text_key", "piece", "leaf")), [encode.join(x, y) if y is not None else x for x, y in sides])

    return run


def far_pieces(texts: DataFrame, source) -> DataFrame:
    """(text) -> (text_key, known: array of piece, ids) for texts with pieces of over ``FAR`` symbols, encoded leaf by leaf and joined level by level over tasks."""
    ddl = "text_key binary, piece binary, leaf bigint, ids array<int>"
    leaves = written(texts.select("text").distinct().mapInArrow(_leaf_rows(source), ddl), "leaves")
    owners = leaves.select("text_key", "piece").distinct()
    level = leaves.dropDuplicates(["piece", "leaf"]).withColumn("text_key", F.lit(None).cast("binary"))
    level = written(level.repartition("piece", "leaf").mapInArrow(_leaves_encoded(source), ddl), "level")
    while (level.agg(F.max("leaf").alias("leaf")).first().leaf or 0) > 0:
        right = F.col("leaf") % 2 == 1
        pairs = level.groupBy("piece", F.floor(F.col("leaf") / 2).alias("leaf")).agg(F.first(F.when(~right, F.col("ids")), True).alias("left"), F.first(F.when(right, F.col("ids")), True).alias("right"))
        pairs = pairs.select(F.lit(None).cast("binary").alias("text_key"), "piece", "leaf", "left", "right")
        level = written(pairs.mapInArrow(_joined(source), ddl), "level")
    return owners.join(level.select("piece", "ids"), "piece").groupBy("text_key").agg(F.collect_list(F.struct("piece", "ids")).alias("known"))


def _encode_rows(source, schema: pa.Schema, carry: int, keep: bool):
    def run(batches):
        encode = _encoder(source)
        for b in sliced(batches, 2048):
            texts = b.column("text").to_pylist()
            known = b.column("known").to_pylist()
            step = 500 if keep else len(texts)
            for at in range(0, len(texts), step or 1):
                out: list[list] = [[], [], [], [], []]
                for t, far in zip(texts[at : at + step], known[at : at + step]):
                    if far:
                        ids = {k["piece"]: k["ids"] for k in far}
                        mine = encode.far(t)
                        for p in mine:
                            encode.know(p, ids[_sha(p)])
                    ids, decoded = encode(t or "")
                    if far:
                        for p in mine:
                            del encode.ids[p], encode.texts[p]
                    row = (ids.count(" ") + 1 if ids else 0, _sha(ids).hex(), _sha(decoded).hex(), ids if keep else None, decoded if keep else None)
                    for c, v in zip(out, row):
                        c.append(v)
                yield batch(schema, *(b.column(k).slice(at, step) for k in range(carry)), *out)
        encode.ids.clear()  # workers live on; what they remember need not
        encode.texts.clear()

    return run


def _encoded(rows: DataFrame, tokenizer_file: str, keep: bool) -> DataFrame:
    """Columns and, last, text -> the columns and ``RESULT``.  The file is read by the driver and its text (under 2 MB) is broadcast."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = rows.sparkSession.sparkContext.broadcast(f.read())
    carry = [c for c in rows.columns if c != "text"]
    # only an unbroken run of FAR / 8 characters can hold a piece of over FAR symbols (at most four bytes a character; normalising may take some)
    unbroken = F.col("text").rlike(rf"(?:^|\s)\S{{{FAR // 8}}}")
    far = rows.where(unbroken)
    none = F.lit(None).cast("array<struct<piece:binary,ids:array<int>>>")
    plain = rows.withColumn("known", none)
    if not far.isEmpty():
        known = written(far_pieces(far, source), "far-pieces")
        shared = far.withColumn("_key", F.unhex(F.sha2("text", 256))).join(known.withColumnRenamed("text_key", "_key"), "_key", "left").select(*rows.columns, "known")
        plain = plain.where(~F.coalesce(unbroken, F.lit(False))).unionByName(shared)
    kinds = StructType([rows.schema[c] for c in carry] + StructType.fromDDL(RESULT).fields)
    return plain.select(*carry, "text", "known").mapInArrow(_encode_rows(source, to_arrow_schema(kinds), len(carry), keep), kinds)


def encode_documents(docs: DataFrame, tokenizer_file: str, keep: bool = True) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256, ids (joined by spaces), decoded; a row per row.

    ids and decoded are null unless ``keep``.  Null and empty text have no tokens.  Ids may be null or repeat; extra
    columns are ignored; no documents, no rows.
    """
    return _encoded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), tokenizer_file, keep)


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The documents' columns but text, and n_tokens, ids_sha256, decoded_sha256, ids; a column called as one of these is replaced."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    names = [c for c in docs.columns if c != "text" and c not in new]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("row")
    out = _encoded(docs.select(row, "text"), tokenizer_file, True)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), *new)
