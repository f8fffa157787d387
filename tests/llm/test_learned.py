import zlib

import numpy as np

from cresthaven.llm import language_id as G
from cresthaven.llm import quality as Y

DOCS = "doc_id bigint, text string, lang string, source string, score double, predicted int"
D = "/root/testdata/sf0.1"


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = G.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    kept = G.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() > 0.99 * len(truth)


def test_tables_are_the_convolution():
    r = np.random.default_rng(0)
    x = r.integers(0, 256, (5, G.WINDOW + G.TAIL), dtype=np.uint8)
    net = G.train(x, np.array([0, 1, 0, 1, 1]), ["a", "b"], epochs=1, size=5)
    e = net.embed[x]
    pooled = [(np.concatenate([e[:, j : j + G.WINDOW] for j in range(w)], axis=2) @ k + b).max(axis=1) for w, k, b in zip(G.WIDTHS, net.kernels, net.bias)]
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_windows_cover_the_text():
    t = "abcdefghij" * 57
    w = G.windows(t)
    assert b"".join(x[: G.WINDOW].tobytes() for x in w)[: len(t)] == t.encode() and w[0][-1] == w[1][G.TAIL - 1]


def test_language_odd_rows(spark):
    assert G.identify(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, f"the and of was {i} with this that", "en", None, None, None) for i in range(30)] + [(i, f"der die das und nicht {i} mit auf", "de", None, None, None) for i in range(30, 60)]
    odd = [(None, None, "en", None, None, None), (None, "", None, None, None, None), (70, "123 !?", "en", None, None, None), (71, "und die der " * 4000, None, None, None, None), (71, "x", None, None, None, None)]
    got = G.identify(spark.createDataFrame(rows + odd, DOCS)).collect()
    assert len(got) == 65
    by = {r.doc_id: r for r in got if r.doc_id == 70}
    assert by[70].lang_pred == "und" and sum(r.lang_pred == "und" for r in got) == 3
    assert "de" in [r.lang_pred for r in got if r.doc_id == 71]
    none = spark.createDataFrame([(1, "words", None, None, None, None)], DOCS)
    assert G.identify(none).first().lang_pred == "und"


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = Y.rank_quality(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    good, bad = ([r.score for r in held if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.97  # area under the curve


def test_pairwise_loss_orders():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = x[:, 0] - 2 * x[:, 3] + 0.1 * r.normal(size=400) > 0
    f = Y.fit_pairs(x, y)
    assert f.weights[3] < -abs(f.weights[1]) and np.mean((f.scores(x) >= 0.5) == y) > 0.93


def test_quality_odd_rows(spark):
    labels = "doc_id bigint, quality int, toxic int, text string"
    rows = [(i, "good words here", "en", None, 0.1, 1) for i in range(40)] + [(i, "!!! ### $$$", "en", None, 0.1, 1) for i in range(40, 80)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None), (5, "", None, None, None, None), (5, "w " * 50_000, None, None, None, None)], DOCS)
    marks = spark.createDataFrame([*((i, int(i < 40), 0, "x") for i in range(80)), (None, 1, 0, None), (3, None, 0, None)], labels)
    got = Y.rank_quality(docs, marks).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 40) for r in got if r.doc_id is not None and r.doc_id != 5)
    assert {r.score for r in Y.rank_quality(docs, spark.createDataFrame([], labels)).collect()} == {0.5}
    assert Y.rank_quality(spark.createDataFrame([], DOCS), marks).count() == 0
