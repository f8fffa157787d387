import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cresthaven.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.Encoder(open(PATH, encoding="utf-8").read()), t


def check(both, text):
    ids, decoded = both[0](text)
    want = both[1].encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)) and decoded == both[1].decode(want, skip_special_tokens=False), repr(text[:80])


def test_texts(both):
    for t in ["", " ", "Hello World's 12345 été!!…  a\tb", "a<|endoftext|>B <|startoftext|><|endoftext|>", "İx ΑΣ ς é", "\x1c\x1d\x85\xa0　x​\xad", "'S 'LL don't''s", "½²³ªº \x00\x7f\x80", "日本語テキスト 🎉👩‍👧", "ßİ" * 50]:
        check(both, t)


def test_random_characters(both):
    r = random.Random(1)
    pool = [chr(c) for c in range(0x250)] + list("αβγΣςжЯ漢字🎉́̈‍ ")
    for _ in range(1500):
        check(both, "".join(r.choice(pool) for _ in range(r.randrange(1, 40))))


def test_long_pieces(both):
    r = random.Random(2)
    for n in (65, 128, 129, 1000, 20_000):
        for alphabet in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz", "éaß", "!?-", "漢字"):
            check(both, "".join(r.choice(alphabet) for _ in range(n)))


def test_growing_windows(both):
    e, r = both[0], random.Random(3)
    for _ in range(300):
        s = [e.vocab[c] for c in (r.choice("aeinrstho") for _ in range(r.randrange(2, 60)))]
        assert e.tree(s, leaf=r.randrange(1, 7)) == e.merge(s)


def test_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH).collect()}
    for r in docs.collect():
        ids = both[1].encode(r.text, add_special_tokens=False).ids
        text = " ".join(map(str, ids))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids, got[r.doc_id].ids_sha256) == (len(ids), text, hashlib.sha256(text.encode()).hexdigest())
        assert got[r.doc_id].decoded == both[1].decode(ids, skip_special_tokens=False)


def test_odd_rows(spark):
    ddl = "doc_id bigint, text string, ids string, n_tokens int"
    assert bpe.encode_documents(spark.createDataFrame([], ddl), PATH).count() == 0
    rows = bpe.encode_documents(spark.createDataFrame([(None, None, "x", 1), (1, "", None, None), (1, "a a", None, None), (1, "a a", None, None)], ddl), PATH, keep=False).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2] and all(r.ids is None for r in rows)


def test_long_pieces_over_tasks(spark, both):
    """Pieces that tasks share: the library's ids, whatever stands around them and however often the text comes."""
    r = random.Random(8)
    run = lambda n, alphabet: "".join(r.choice(alphabet) for _ in range(n))
    a, b = run(40_000, "abcdefgh"), run(15_000, "漢字仮名")
    texts = [f"start {a} middle {a.upper()} and {b}, end", a, run(70_001, "ab"), "x" * (bpe.FAR + 1), "short text", None, run(5000, "ab"), f"<|endoftext|>{a}<|endoftext|>"]
    rows = [(k, t, "n", b"k") for k, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, known string, piece binary")
    got = {x.doc_id: x for x in bpe.encode_documents(docs, PATH).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == " ".join(map(str, ids)) and got[k].n_tokens == len(ids) and got[k].decoded == both[1].decode(ids, skip_special_tokens=False)
    plan = bpe.far_pieces(docs.where("length(text) > 5000"), spark.sparkContext.broadcast(open(PATH, encoding="utf-8").read())).collect()
    assert sum(len(p.known) for p in plan) == 6


def test_other_files_are_refused():
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": None}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Encoder(json.dumps(spec | change))
