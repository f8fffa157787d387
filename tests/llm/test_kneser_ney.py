import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cresthaven.llm import kneser_ney as K

DDL = "doc_id bigint, text string, score double, n int"


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def brute(rows):
    """{row index: (held, n_tokens, n_known, N, base, score)} with dictionaries."""
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    uni, bi, docs = Counter(), Counter(), 0
    for (_, t), h in zip(rows, held):
        if not h:
            docs += 1
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<"] + w[:-1], w))
    of = lambda cs: Counter(cs)
    cc = of(bi.values())
    d = K.discounts(*(cc[k] for k in (1, 2, 3, 4)))
    left = Counter(w for _, w in bi)
    lc = of(left.values())
    low = K.discounts(*(lc[k] for k in (1, 2, 3, 4)))
    n, v = sum(left.values()) or 1, len(uni)
    floor = sum(low[min(x, 3) - 1] for x in left.values()) / n / (v + 1) if v else 1.0
    lower = {w: (x - low[min(x, 3) - 1]) / n + floor for w, x in left.items()}
    total, freed = Counter(), defaultdict(float)
    for (a, _), c in bi.items():
        total[a] += c
        freed[a] += d[min(c, 3) - 1]
    big_n, out = sum(uni.values()), []
    for (_, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10((uni[x] + 1) / (big_n + v + 1)) for x in w)
        score = 0.0
        for a, x in zip(["<"] + w[:-1], w):
            c = bi[a, x]
            high = (c - d[min(c, 3) - 1]) / total[a] if c else 0.0
            lam = freed[a] / total[a] if total[a] else 1.0
            score += math.log10(high + lam * lower.get(x, floor))
        out.append((h, len(w), sum(uni[x] > 0 for x in w), big_n, base, score))
    # the model is a distribution: over all words and the unknown one it sums to 1
    for a in list(total)[:20]:
        s = sum((bi[a, x] - d[min(bi[a, x], 3) - 1]) / total[a] if bi[a, x] else 0.0 for x in uni) + freed[a] / total[a] * (sum(lower.values()) + floor)
        assert s == pytest.approx(1.0)
    return out


def check(spark, rows, df):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in K.score_documents(df).collect())
    want = sorted((str(i), h, n, k, t, round(b, 6), round(s, 6)) for (i, _), (h, n, k, t, b, s) in zip(rows, brute(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=2e-5)


def test_sample_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.collect()], df)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a b a B"), (3, "unseen words"), (3, "unseen words"), (4, "a\x0bb  é É")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], DDL)
    check(spark, rows, df)
    assert K.score_documents(spark.createDataFrame([], DDL)).count() == 0


def test_counter_hands_over_and_loses_nothing():
    import numpy as np

    c, got = K.Counter(most=50), Counter()
    r = np.random.default_rng(0)
    keys = r.integers(0, 200, 5000).astype(np.uint64)
    for part in np.split(keys, 100):
        if full := c.add(part):
            for a, b in zip(*full):
                got[a] += b
            c_seen = True
    for a, b in zip(*(c.rest() or ([], []))):
        got[a] += b
    assert got.total() == 5000 and c_seen


def test_counts_beyond_32_bits(tmp_path):
    """A pair counted more often than 32 bits hold keeps its count."""
    import numpy as np
    import pyarrow as pa

    from cresthaven.llm import kneser_ney as K

    big = 2**32 + 5
    rows = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([0, 1, 1], [1, 2, 2], [3, 2**32, 5])], schema=K.PAIRS)
    out = pa.Table.from_batches(list(K._pair_files(str(tmp_path), K.Ranges(10, 9, 1, []))(iter([rows])))).to_pylist()
    (file,) = [(r["low"], r["high"], r["name"]) for r in out if r["name"]]
    keys = np.array([1, (1 << 32) | 2, (1 << 32) | 3], np.uint64)
    assert K.look_up(str(tmp_path), [file], K.BIGRAMS, keys, ["c"])[0].tolist() == [3, big, 0]


def test_too_many_words_are_refused(spark, monkeypatch):
    import pytest

    from cresthaven.llm import kneser_ney as K

    monkeypatch.setattr(K, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        K.train(spark.createDataFrame([("a b c d e",)], "text string"))


def test_hot_histories_are_split(spark, monkeypatch):
    """Ranges of what follows a hot history lie in files of their own; scores stay the same."""
    import random

    from cresthaven.llm import kneser_ney as K

    r = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(r.choice(["the", "the", f"w{r.randrange(60)}"]) for _ in range(r.randrange(30)))) for k in range(120)], "doc_id bigint, text string")
    plain = K.train(docs)
    want = {x.doc_id: x.score for x in K.score(docs, plain).collect()}
    monkeypatch.setattr(K, "LEAST_HOT", 5)
    split = K.train(docs)
    assert len(split.pairs) > len(plain.pairs)
    assert {x.doc_id: x.score for x in K.score(docs, split).collect()} == want


def test_tokens_are_words_at_ascii_white_space():
    import numpy as np
    import pyarrow as pa
    import xxhash

    from cresthaven.llm import kneser_ney as K

    texts = [" A  b ", "", None, "  ", "x\x0by\x1cz\x85 q r　", "É é a\tB\nb\r\x0c", "one"]
    for some in (texts, texts[1:4], texts[:1], texts[-1:]):
        kinds, back, ends = K.tokens(pa.array(some))
        assert (np.diff(kinds.astype(object)) > 0).all() and set(back.tolist()) == set(range(len(kinds)))
        want = [w for t in some for w in [*(t or "").encode().lower().split(), b"\n"]]
        assert kinds[back].tolist() == [xxhash.xxh64_intdigest(w, 42) for w in want]
        assert ends.tolist() == np.cumsum([len((t or "").encode().split()) + 1 for t in some]).tolist()
    assert [(at, len(s)) for at, s in K._slices(pa.array(["aaa", None, "bb", "c" * 9, "d"]), 5)] == [(0, 3), (3, 1), (4, 1)]


def test_texts_are_split_into_words_four_megabytes_at_a_time():
    """What a worker holds follows the slice, not the batch."""
    import pyarrow as pa

    from cresthaven.llm import kneser_ney

    column = pa.array(["a " * (1 << 19)] * 11 + [None, "b " * (3 << 20)])
    sizes = [sum(len(t or "") for t in texts.to_pylist()) for _, texts in kneser_ney._slices(column)]
    assert sum(sizes) == (11 << 20) + (6 << 20) and sorted(sizes)[-1] == 6 << 20 and sorted(sizes)[-2] <= 4 << 20


def test_sums_are_sent_in_small_batches(tmp_path):
    """A batch lies in the JVM outside its heap, whole."""
    import numpy as np
    import pyarrow as pa

    from cresthaven.llm import kneser_ney as K

    n = 150_000
    texts = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}" for k in range(at, at + 1000)) for at in range(0, n, 1000)]})
    words = list(K._lean(K._word_counts)(iter([texts])))
    assert max(b.num_rows for b in words) <= 1 << 16 and sum(b.num_rows for b in words) == n + 1
    t = pa.Table.from_batches(words)
    keys = t["hash"].to_numpy().view(np.uint64)
    assert (keys[1:] > keys[:-1]).all() and t["c"].to_numpy()[keys == K.END] == n // 1000
    file = K._write(str(tmp_path), [keys, np.arange(1, n + 2, dtype=np.int64)])
    pairs = list(K._pair_counts(str(tmp_path), K._files([type("File", (), {c: file[c][0].as_py() for c in ("low", "high", "name")})]))(iter([texts])))
    assert max(b.num_rows for b in pairs) <= 1 << 16 and sum(b.num_rows for b in pairs) == sum(sum(b["c"].to_pylist()) for b in pairs) == n + n // 1000
    out = list(K._pair_files(str(tmp_path), K.Ranges(n + 2, n + 1, 1, []))(iter(pairs)))
    assert max(b.num_rows for b in out) <= 1 << 16
