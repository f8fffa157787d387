import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import words
from tests.llm.test_simhash_dedup import clusters, plain
from tests.llm.test_suffix_dedup import brute as removed

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["language_id", "simhash_dedup", "suffix_dedup", "decontaminate", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    load = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])
    known = stage["language_id"](spark, docs, D).cache()
    assert known.columns == columns and 0 <= docs.count() - known.count() <= 2
    unique = stage["simhash_dedup"](spark, known, D).cache()
    rows = load(known)
    assert unique.columns == columns and [r[0] for r in load(unique)] == sorted({rows[c][0] for c in clusters([plain(t) for _, t in rows])})
    cut = stage["suffix_dedup"](spark, unique, D).cache()
    rows = load(unique)
    kept = dict(load(cut))
    for (i, t), (n, gone, spans, sha) in zip(rows, removed(rows, 100)):
        assert i in kept or gone
        assert i not in kept or not gone and kept[i] == t or gone and len(kept[i].encode()) <= n - gone
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in cut.collect())
    clean = stage["decontaminate"](spark, cut, D).cache()
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaking = {i for i, t in kept.items() if any(x in " ".join(words(t)) for x in items)}
    assert clean.columns == columns and leaking <= kept.keys() - {i for i, _ in load(clean)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(load(clean))
    for r in stage["bpe"](spark, clean, D).collect():
        assert r.ids == " ".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids))


def test_run_is_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, D)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and 50 < out.count() <= 200


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc int, key string, row int, id string, n_bytes int, marks string, kept_text string, leak string, component_id int, ids string, known int, _lang string"
EXTRA = (77, "k", 5, "i", -1, "m", "t", "l", 3, "own ids", 4, "x")


def odd(spark):
    """Documents with nulls everywhere, repeated rows and ids, a very long text, and columns called as those the stages make."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{D}/documents.parquet").limit(120).collect()]
    item = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    long = " ".join(base[k % 100][1] for k in range(400))
    more = [(None, None, None, None, None), (None, base[1][1], "en", None, None), (900, "", "en", "s", 0), (901, None, None, "s", None), (902, "12 34 !!", None, None, 8), (903, f"Well. {item} So.", "en", "s", 1), (904, long, None, "s", len(long)), (905, base[3][1], None, "b", 1), (905, base[3][1], None, "a", 1)]
    return spark.createDataFrame([(*r, *EXTRA) for r in [*base, *more, more[-1], base[5]]], ODD).repartition(3)


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    extra = docs.columns[5:]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), D)
        assert empty.count() == 0
        out = stage(spark, docs, D)
        rows = out.collect()
        assert rows, name
        if name != "bpe":
            assert out.columns == empty.columns == docs.columns, name
            assert {tuple(r[c] for c in extra) for r in rows} == {EXTRA}, name
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        if name == "language_id":
            assert not {900, 901, 902} & set(by) and len(by[905]) == 3 and 904 in by and len(by[None]) == 1
        if name == "simhash_dedup":
            assert all(len(v) == 1 for v in by.values()) and 905 not in by and 900 in by and 901 not in by
        if name == "suffix_dedup":
            assert by[900][0].text == "" and by[901][0].text is None and len(by[0]) >= 1 and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
            assert 904 not in by or len(by[904][0].text) < 200_000
        if name == "decontaminate":
            assert 903 not in by and {900, 901, 902, None} <= set(by) and len(by[905]) == 3
        if name == "bpe":
            assert len(rows) == docs.count() and by[901][0].n_tokens == 0 and by[905][0].doc == 77 and by[905][0].ids != "own ids" and "text" not in out.columns


def test_ties_of_an_id(spark):
    """Of rows that repeat an id the first in the order of the whole row stays."""
    ddl = "doc_id bigint, text string, source string"
    rows = [(4, "one two three four five six", "b"), (4, "one two three four five six", "a"), (5, "one two three four five six", "a"), (None, "other words entirely in this one", "z"), (None, "one two three four five six", "z")]
    for order in (rows, rows[::-1]):
        got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, spark.createDataFrame(order, ddl), D).collect()
        assert sorted((str(r.doc_id), r.source) for r in got) == [("4", "a"), ("None", "z")]
