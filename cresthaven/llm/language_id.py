"""Language identification by a byte convolutional network, trained here in numpy.

A text's lower-cased UTF-8 bytes are cut into windows of ``WINDOW`` positions (each also reads the next
``max(WIDTHS)-1`` bytes), so windows cover the whole text.  Byte embeddings pass through filters of several widths, a
rectifier and max pooling over the window, then softmax; a document's probabilities are its windows' mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, sliced

WINDOW, WIDTHS, EMBED, FILTERS = 96, (2, 3, 4), 8, 16
TAIL = max(WIDTHS) - 1
LETTER = regex.compile(r"\p{L}")
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def windows(text: str | None) -> np.ndarray:
    """(number of windows, WINDOW + TAIL) bytes, zero-padded; an empty text has none."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "ignore"), np.uint8)
    n = -(-len(raw) // WINDOW)
    padded = np.zeros(n * WINDOW + TAIL, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + TAIL)[::WINDOW] if n else padded[:0].reshape(0, WINDOW + TAIL)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernels: list[np.ndarray]  # width*EMBED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # len(WIDTHS)*FILTERS x langs
    out_bias: np.ndarray

    def tables(self):
        """The convolution of a pair of bytes, of a single byte and of the second pair, as lookup tables: the same sums, precomputed."""
        e = self.embed
        part = [[e @ k[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, k in zip(WIDTHS, self.kernels)]
        first = np.concatenate([(p[0][:, None] + p[1][None] + b).reshape(65536, FILTERS) for p, b in zip(part, self.bias)], axis=1)
        return first.astype(np.float32), part[1][2].astype(np.float32), (part[2][2][:, None] + part[2][3][None]).reshape(65536, FILTERS).astype(np.float32)

    def probabilities(self, wins: np.ndarray, tables, step: int = 128) -> np.ndarray:
        first, third, last = tables
        out = np.empty((len(wins), len(self.langs)), np.float32)
        for at in range(0, len(wins), step):
            x = wins[at : at + step]
            pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
            h = first[pairs[:, :WINDOW]]
            h[:, :, FILTERS : 2 * FILTERS] += third[x[:, 2 : 2 + WINDOW]]
            h[:, :, 2 * FILTERS :] += last[pairs[:, 2 : 2 + WINDOW]]
            z = np.maximum(h.max(axis=1), 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + step] = z / z.sum(axis=1, keepdims=True)
        return out


def train(wins: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, size: int = 128, seed: int = 3) -> Network:
    """Adam on cross-entropy; gradients flow through the pooled positions only."""
    r = np.random.default_rng(seed)
    net = Network(langs, r.normal(0, 0.5, (256, EMBED)), [r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))
    params = [net.embed, *net.kernels, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-200 * size // max(1, len(wins))))):  # few windows: at least some 200 steps
        order = r.permutation(len(wins))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x, y, n = wins[pick], labels[pick], len(pick)
            e = net.embed[x]
            pooled, where = [], []
            for w, k, b in zip(WIDTHS, net.kernels, net.bias):
                cols = np.concatenate([e[:, j : j + WINDOW] for j in range(w)], axis=2)
                h = cols @ k + b
                pos = h.argmax(axis=1)
                pooled.append(np.take_along_axis(h, pos[:, None], 1)[:, 0])
                where.append(pos)
            h = np.concatenate(pooled, axis=1)
            a = np.maximum(h, 0)
            z = a @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            back = (p @ net.out.T) * (h > 0)
            g_embed, g_kernels, g_bias = np.zeros_like(net.embed), [], []
            rows = np.arange(n)[:, None]
            for i, (w, k) in enumerate(zip(WIDTHS, net.kernels)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                gk = np.empty_like(k)
                for j in range(w):
                    at_bytes = x[rows, where[i] + j]
                    gk[j * EMBED : (j + 1) * EMBED] = np.einsum("nf,nfe->ef", g, net.embed[at_bytes])
                    np.add.at(g_embed, at_bytes, g[:, :, None] * k[j * EMBED : (j + 1) * EMBED].T[None])
                g_kernels.append(gk)
                g_bias.append(g.sum(axis=0))
            t += 1
            for q, (p_, g) in enumerate(zip(params, [g_embed, *g_kernels, *g_bias, a.T @ p, p.sum(axis=0)])):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                p_ -= 0.004 * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return net


def _training_windows(per_doc: int):
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("window", pa.binary())])

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for text, lang, order in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("order").to_pylist()):
                w = windows(text)
                pick = np.random.default_rng(order & 0xFFFFFFFF).permutation(len(w))[:per_doc]
                out[0] += [lang] * len(pick)
                out[1] += [order] * len(pick)
                out[2] += [w[i].tobytes() for i in np.sort(pick)]
            yield batch(schema, *out)

    return run


def fit(labelled: DataFrame, per_lang: int = 600, per_doc: int = 5) -> Network | None:
    """Train on (text, lang, doc_id) rows; None where there are none.

    Bounded sample: about ``per_lang`` documents of each language, chosen by a hash of the id, with up to ``per_doc``
    windows of each, at random places of the whole text.
    """
    labelled = labelled.select("doc_id", "text", "lang")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    share = F.broadcast(counts.select(F.col("lang").alias("_lang"), (F.lit(per_lang) / F.col("n")).alias("_share")))  # a row per language
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample"))
    picked = usable.join(share, F.col("lang") == F.col("_lang")).where(F.pmod(order, F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    rows = picked.select("text", "lang", order.alias("order")).mapInArrow(_training_windows(per_doc), "lang string, order bigint, window binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.order, r.lang, r.window))
    langs = sorted({r.lang for r in rows})
    wins = np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(len(rows), -1)
    return train(wins, np.array([langs.index(r.lang) for r in rows]), langs)


def _predict_rows(shared):
    def run(batches):
        net = shared.value
        tables = net.tables() if net else None
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), 64):
                some = [t if t and LETTER.search(t) else "" for t in texts[at : at + 64]]
                cut = [windows(t) if net else windows("") for t in some]
                sizes = [len(w) for w in cut]
                p = net.probabilities(np.concatenate(cut), tables) if sum(sizes) else np.zeros((0, 1))
                end = 0
                for n in sizes:
                    mean = p[end : end + n].mean(axis=0) if n else None
                    end += n
                    langs.append("und" if mean is None else net.langs[int(mean.argmax())])
                    scores.append(0.0 if mean is None else min(1.0, float(mean.max())))
            yield batch(RESULT, b.column("doc_id"), langs, scores)

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, text, ...) -> a row per row: doc_id, lang_pred, score.

    A null text, one without a letter, or any text where the network is None (nothing to learn from): ``und``, 0.
    Ids may be null or repeat; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select("doc_id", "text").mapInArrow(_predict_rows(shared), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents' own labels outside the held-out third, then predict all: doc_id, held_out, lang_pred, score."""
    net = fit(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _keep_rows(shared, least: float):
    inner = _predict_rows(shared)

    def run(batches):
        for b in sliced(batches):
            t = pa.Table.from_batches([b])
            named = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text")], names=["doc_id", "text"])
            p = next(inner(iter([named])))
            keep = [lang != "und" and s >= least for lang, s in zip(p.column("lang_pred").to_pylist(), p.column("score").to_pylist())]
            yield from t.filter(pa.array(keep, pa.bool_())).to_batches()

    return run


def drop_unidentified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents, all columns, whose language is found with probability ``least`` or more.

    Texts that are null, empty or have no letter go; so do all where no row has a language to learn from.  Rows that
    repeat stay as often as they come; no column but doc_id, text and lang is read.
    """
    from pyspark.sql.types import StructType

    net = fit(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_keep_rows(shared, least), StructType(docs.schema.fields))
