"""Quality scores by Bradley-Terry pairwise ranking.

From labelled documents, pairs (better, worse) are drawn; logistic loss on the difference of their features gives a
linear score.  The score quantile that leaves the labelled share of good documents above it becomes the threshold,
and a logistic curve through it maps scores to (0, 1) with the threshold at one half.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, utf8

SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_KIND = np.zeros(256, np.int64)
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?'\"-", b"!", bytes(range(128, 256))), 1):
    _KIND[list(_s)] = _k


def features(text: bytes) -> np.ndarray:
    """Byte shares (square roots), byte-class shares and repetition measures of a whole text; an empty one gives zeros and a flag."""
    raw = np.frombuffer(text, np.uint8)
    count = np.bincount(raw, minlength=256) / max(1, len(raw))
    kinds = np.bincount(_KIND, weights=count, minlength=9)
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    top = sum(c for _, c in seen.most_common(3)) / n
    more = [
        float(not words), np.log1p(len(words)), len(words) ** -0.5 if words else 1.0, len(seen) / n, len(seen) / n**0.8, again, again > 0.05, top, seen.most_common(1)[0][1] / n if words else 0.0,
        len(text) / n / 10, len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))), sum(c for c in seen.values() if c > 1) / n, np.log1p(max(map(len, words), default=0)),
    ]
    return np.concatenate([np.sqrt(count), kinds, np.sqrt(kinds), np.array(more, float)])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold), -40, 40)))


def fit_pairs(x: np.ndarray, good: np.ndarray, rounds: int = 400, size: int = 2048, penalty: float = 1e-3, seed: int = 5) -> Ranker:
    """Adam on the mean logistic loss of random (good, bad) pairs plus a squared penalty."""
    r = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(z.shape[1])
    a, b = z[good], z[~good]
    m, v = np.zeros_like(w), np.zeros_like(w)
    if len(a) and len(b):
        for t in range(1, rounds + 1):
            d = a[r.integers(0, len(a), size)] - b[r.integers(0, len(b), size)]
            g = -d.T @ (1 / (1 + np.exp(np.clip(d @ w, -40, 40)))) / size + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    share = float(good.mean())
    cut = float(np.quantile(raw, 1 - share)) if 0 < share < 1 else (-1e9 if share else 1e9)
    return Ranker(mean, scale, w, cut, 4 / max(float(raw.std()), 1e-9))


def _feature_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])
    for b in batches:
        yield batch(schema, b.column("doc_id"), b.column("quality"), [features(t).tolist() for t in utf8(b.column("text"))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Ranker | None:
    """Learn from documents joined with (doc_id, quality); None where no label can be used.

    Bounded sample: about ``per_class`` labels of each class by a hash of the id, all where there are fewer.  Labels
    with a null id or quality are left out; an id with several labels counts once for each.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    n = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    bound = F.when(F.col("quality") == 1, F.lit(per_class / max(1, n.get(1, 1)))).otherwise(F.lit(per_class / max(1, n.get(0, 1))))
    sample = F.broadcast(usable.where(place < bound * (1 << 30)))  # about 2 * per_class rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(_feature_rows, "doc_id bigint, quality int, x array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    return fit_pairs(np.array([r.x for r in rows]), np.array([r.quality == 1 for r in rows]))


def _score_rows(shared):
    def run(batches):
        ranker = shared.value
        for b in batches:
            texts = utf8(b.column("text"))
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                s = ranker.scores(np.stack([features(t) for t in part])) if ranker else np.full(len(part), 0.5)
                yield batch(SCORES, b.column("doc_id").slice(at, 512), s)

    return run


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """(doc_id, text, ...) -> a row per row: doc_id, score, predicted (1 if score >= 0.5).

    Null text counts as empty; an empty text has a score like any other.  Without a ranker every score is 0.5.  Ids may
    be null or repeat; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    out = docs.select("doc_id", "text").mapInArrow(_score_rows(shared), "doc_id bigint, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
