import random
from collections import Counter

import regex

from cresthaven.llm import decontaminate as D

DDL = "doc_id bigint, text string, item_id string, start int, similarity double"
ITEMS = "item_id bigint, text string, doc_id int"


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def bag(w, k):
    return Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, least=0.8):
    """Every item-sized window of every document against every item."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            want, best = bag(v, k), (0, 0)
            for s in range(max(1, len(w) - len(v) + 1)):
                have = bag(w[s : s + len(v)], k)
                both = (have & want).total()
                best = max(best, (both / (have.total() + want.total() - both), -s))
            if best[0] >= least:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def run(spark, docs, items):
    a = spark.createDataFrame([(d, t, "x", 1, 0.5) for d, t in docs], DDL).repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in D.leaks(a, b).collect()}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["alpha", "béta", "gamma", "delta", "of", "the", "x1", "ω", "zeta", "eta", "iota", "kappa", "mu", "nu"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 4, 8, 14, 25, 40])))) for i in range(12)] + [(50, ""), (51, None), (52, "...")]
    docs = []
    for d in range(80):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))]
        if r.random() < 0.7:
            w = (r.choice(items[:12])[1]).split(" ")
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + ["EDIT"] + w[k:], w[:k] + ["swap"] + w[k + 1 :]])
            parts.insert(r.randrange(2), ", ".join(w).upper() + ".")
        docs.append((d, " ".join(parts)))
    return docs + [(100, ""), (101, None), (102, "?!")], items


def test_against_all_windows(spark):
    docs, items = corpus(1)
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_sample_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    inside = {(a, b) for a, t in docs for b, u in items if " ".join(words(u)) in " ".join(words(t))}
    got = run(spark, docs, items)
    assert inside and inside <= set(got)
    few = {d for d, _ in list(got)[:6]} | {d for d, _ in docs[:25]}
    assert brute([x for x in docs if x[0] in few], items) == {k: v for k, v in got.items() if k[0] in few}


def test_native_plan(spark):
    docs, items = corpus(2)
    a = spark.createDataFrame([(d, t, "x", 1, 0.5) for d, t in docs], DDL)
    plan = D.leaks(a, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_tables(spark):
    empty, items = spark.createDataFrame([], DDL), spark.createDataFrame([(1, "a b c d e f", 1), (None, "g h i j k l", 1), (1, "a b c d e f", 1)], ITEMS)
    assert D.leaks(empty, items).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f", None, None, None), (7, "x g h i j k l", None, None, None), (7, "x g h i j k l", None, None, None), (8, "clean words only in here", None, None, None)], DDL)
    assert D.leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert sorted((str(r.doc_id), str(r.item_id)) for r in D.leaks(docs, items).collect()) == [("7", "None"), ("None", "1")]
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [8]


def test_the_index_finds_the_items(spark, monkeypatch):
    """The prefilter knows no items: without an item's rows in the index, or with another's fingerprint there, it is not found."""
    docs, items = corpus(1)
    want = run(spark, docs, items)
    true = D.index_of
    monkeypatch.setattr(D, "index_of", lambda i: true(i).where("item_id != 4"))
    assert run(spark, docs, items) == {k: v for k, v in want.items() if k[1] != 4} != want
    monkeypatch.setattr(D, "index_of", lambda i: true(i.withColumn("item_fp", D.F.expr("~item_fp"))))
    assert run(spark, docs, items) == {}


def test_index_holds_every_fingerprint_within_the_radius(spark):
    r = random.Random(9)
    rows = []
    for k in range(300):
        fp = r.getrandbits(64)
        other = fp
        for b in r.sample(range(64), r.choice([0, 1, 8, 16, 22, 23, 24, 30])):
            other ^= 1 << b
        rows.append((k, *(x - (1 << 64) if x >> 63 else x for x in (fp, other)), (fp ^ other).bit_count()))
    df = spark.createDataFrame(rows, "item_id bigint, item_fp bigint, fp bigint, far int").selectExpr("*", "item_id as item_key", "7 as n_words", "5 as width", "item_id as doc", "0 as key", "0 as start")
    met = D.near_items(df.select("doc", "key", "n_words", "width", "start", "fp"), D.index_of(df)).where("doc = item_id").collect()
    assert sorted(m.doc for m in met) == [k for k, *_, far in rows if far <= 23]


def test_long_items_and_clashing_columns(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(4000)}" for _ in range(700)]
    near = [*long[:300], "edit", *long[301:]]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 150 + near), 7, "k", "e"), (1, "clean", 8, None, "e"), (2, None, 9, "k", "e"), (3, "a clean text", 9, "k", "e"), (3, "a clean text", 9, "k", "e")], "doc_id bigint, text string, leak int, row string, id string")
    items = spark.createDataFrame([(5, " ".join(long))], "item_id bigint, text string")
    (found,) = D.leaks(docs, items).collect()
    assert (found.doc_id, found.start, found.n_words) == (1, 150, 700) and found.similarity > 0.95
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted((x.doc_id, x.leak, x.row, x.id) for x in kept.collect()) == [(2, 9, "k", "e"), (3, 9, "k", "e"), (3, 9, "k", "e")]
