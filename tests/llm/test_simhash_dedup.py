import random
from itertools import combinations

import numpy as np
import xxhash

from cresthaven.llm import simhash_dedup as H
from cresthaven.llm.components import components

DDL = "doc_id bigint, text string, fp string, component_id int"


def plain(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def clusters(fps, radius=4):
    """{index: least index reachable}, by all pairs."""
    root = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_fingerprint():
    for t in ["", " \t", "One", "a b c d", "A b\x0bC d E", "é É ß " * 30, "w " * 700, "x y z " * 100]:
        assert H.fingerprint(t.encode()) == plain(t)


def test_covering_guarantee():
    r = random.Random(2)
    ms = [m & (2**64 - 1) for m in H.masks(4)]
    assert len(ms) == 31
    for _ in range(3000):
        d = sum(1 << b for b in r.sample(range(64), 4))
        assert any(d & m == 0 for m in ms)


def test_forest_keeps_components():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 3, dtype=np.uint64)
    x = np.unique([int(b) ^ sum(1 << int(k) for k in r.integers(0, 64, r.integers(0, 7))) for b in base for _ in range(60)]).astype(np.uint64)
    for part in (x, x[:11]):
        want = clusters([int(v) for v in part])
        index = {int(v): i for i, v in enumerate(part)}
        root = list(range(len(part)))
        for a, b in H.forest(part, 4):
            i, j = sorted((root[index[a]], root[index[b]]))
            root = [i if q == j else q for q in root]
        assert root == want


def test_sample_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    fps = [plain(t) for _, t in rows]
    want = {rows[i][0]: (fps[i], rows[c][0]) for i, c in enumerate(clusters(fps))}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in H.simhash_components(docs).collect()}
    assert got == want
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_large_buckets_are_searched_in_chunks(spark):
    r = random.Random(9)
    fps = list({r.getrandbits(8) << 20 | r.getrandbits(6) for _ in range(900)} | {r.getrandbits(64) - 2**63 for _ in range(50)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = clusters([f % 2**64 for f in fps])
    got = {x.node: x.root for x in components(H.links(df, 4, largest=40)).collect()}
    mine = {}
    for f, w in zip(fps, want):
        mine.setdefault(w, []).append(f)
    for members in mine.values():
        assert {got.get(f, f) for f in members} == {min(members)}


def test_odd_rows(spark):
    assert H.simhash_components(spark.createDataFrame([], DDL)).count() == 0
    odd = spark.createDataFrame([(None, None, "x", 1), (5, "", "x", 1), (5, "", "x", 1), (2, "a b c", None, None), (9, "a  b\tC", None, None), (None, "lone words here now", None, None)], DDL)
    got = sorted((str(r.doc_id), r.component_id) for r in H.simhash_components(odd).collect() if r.doc_id is not None)
    assert got == [("2", 2), ("5", 5), ("5", 5), ("9", 2)]
    kept = sorted(str(r.doc_id) for r in H.drop_near_duplicates(odd).collect())
    assert kept == ["2", "5", "None"]
