import hashlib
import random

import numpy as np
import pytest

from cresthaven.llm import suffix_dedup as S

DDL = "doc_id bigint, text string, source string, anchor string, start int"


def brute(docs, length):
    """{doc index: (n_removed, n_spans, sha of the kept bytes)} by a set of all strings seen."""
    seen, out = set(), []
    for _, text in docs:
        b = (text or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            if g in seen:
                covered[i : i + length] = True
            seen.add(g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])) == 1)
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        out.append((len(b), int(covered.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, docs, length, gram):
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in docs], DDL).repartition(3)
    rows = S.remove_repeats(df, length, gram=gram).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "bé", "gamma", "of", "the", "x", "delta\n", "ω"]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages).split(" ")
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "EDIT"
            parts.insert(r.randrange(len(parts) + 1), " ".join(p))
        docs.append((i * 3, " ".join(parts)))
    docs += [(1, ""), (2, None), (4, "aaaa" * 80), (5, "ab" * 100), (7, docs[3][1]), (8, docs[3][1])]
    return sorted(docs)


@pytest.mark.parametrize("length,gram", [(40, 12), (100, 32)])
def test_matches_brute_force(spark, length, gram):
    docs = corpus(length)
    assert run(spark, docs, length, gram) == {d[0]: b for d, b in zip(docs, brute(docs, length))}


def test_whole_sample_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == {d[0]: b for d, b in zip(docs, brute(docs, 100))}


def test_hot_anchor_over_many_buckets(spark):
    """One passage with other words around it in most documents: its anchors meet in several buckets."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(70))
    docs = [(i, "".join(r.choice("klmnop") for _ in range(r.randrange(1, 90))) + passage + "".join(r.choice("klmnop") for _ in range(50))) for i in range(300)]
    docs += [(1000 + i, docs[i][1][10:]) for i in range(0, 300, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert run(spark, docs, 60, 16) == {d[0]: b for d, b in zip(docs, brute(docs, 60))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunks_of_a_long_text(monkeypatch):
    text = random.Random(1).randbytes(5000).hex().encode() * 2
    whole = S.runs(text, 100)
    monkeypatch.setattr(S, "CHUNK", 700)
    parts = S.runs(text, 100)
    assert set(whole[0].tolist()) <= set(parts[0].tolist()) and parts[1][-1] == whole[1][-1]


def test_empty_and_odd_rows(spark):
    empty = spark.createDataFrame([], DDL)
    assert S.remove_repeats(empty).count() == 0 and S.dedup_documents(empty).count() == 0
    r = random.Random(3)
    long = "passage " * 3 + "".join(r.choice("abc ") for _ in range(200))
    odd = spark.createDataFrame([(None, long, None, None, None), (3, long, None, None, None), (3, long, None, None, None), (4, None, None, None, None)], DDL)
    got = sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(odd).collect())
    assert got == [("3", len(long)), ("3", len(long)), ("4", 0), ("None", 0)]


def test_multikey_quicksort():
    words = np.random.default_rng(0).integers(0, 3, (6000, 5)).astype(np.uint64)
    order = S.multikey_quicksort(words, small=16)
    assert words[order].tolist() == sorted(words.tolist())


def test_small_bloom_filter_only_lets_more_pass(spark, monkeypatch):
    docs = corpus(8)
    monkeypatch.setattr(S, "MOST_BITS", 1 << 10)
    assert run(spark, docs, 40, 12) == {d[0]: b for d, b in zip(docs, brute(docs, 40))}


def test_hash_is_sparks(spark):
    a = [5, -7, 2**62 + 3]
    want = [r.h for r in spark.createDataFrame([(x,) for x in a], "a bigint").selectExpr("xxhash64(a, 3) h").collect()]
    assert S.spark_hash(np.array(a).view(np.uint64), 3).view(np.int64).tolist() == want
