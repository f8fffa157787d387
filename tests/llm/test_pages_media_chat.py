import hashlib
import random
import re
import struct
import zlib
from html import unescape

from cresthaven.llm import media as M
from cresthaven.llm import page_text as T
from cresthaven.llm import quotation as C
from cresthaven.llm.common import written

PAGES = "page_id bigint, url string, html string, text string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h") for r in rows], PAGES)


def extract(spark, rows):
    return {r.page_id: r.text for r in T.extract_pages(pages(spark, rows)).collect()}


def test_sample_pages_by_hand(spark):
    """The sample pages hold one article each: its blocks, by a plain split."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in T.extract_pages(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", re.sub(r"<br>", " ", body)))
        want = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert got[r.page_id] == (want, len(want))


def test_parts_that_are_no_article(spark):
    page = """<html><head><title>T</title><script>if (a<b) x="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav>menu</nav>
    <div class="notice cookie">accept</div><aside>side</aside><main><article><h2>A &amp; B&nbsp;c</h2><p>one <b>two</b>
    three<p>four &lt;five&gt;<div class="ad">buy</div><ul><li>six</li><li>seven<br>eight</li></ul><form><p>sign up</p></form><!-- <p>hidden</p> -->
    <section id="comments"><p>first!</p></section><style>p{}</style></article><div class="related">more</div></main><footer>end</footer></body></html>"""
    assert extract(spark, [(1, "http://a.b/c", page)])[1] == "A & B c\none two three\nfour <five>\nsix\nseven eight"


def test_without_article_the_template_decides(spark):
    words = random.Random(1)
    body = lambda: " ".join(words.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(80))
    texts = [body() for _ in range(6)]
    rows = [(i, "https://x.org/" + str(i), f'<html><body><div id="top"><a href="/">home</a> <a href="/b">b</a></div><div id="text"><p>{t}</p></div><div class="sidebar">{body()} {body()}</div></body></html>') for i, t in enumerate(texts)]
    assert extract(spark, rows) == dict(enumerate(texts))


def test_odd_pages(spark):
    assert T.extract_pages(spark.createDataFrame([], PAGES)).count() == 0
    deep = "<article>" + "<div>" * 500 + "<p>deep</p>" + "</div>" * 500 + "</article>"
    rows = [(None, None, None), (1, None, ""), (2, "nonsense", "no tags at all"), (3, "http://h", "<article><p>cut off in a <b"), (4, "http://h", "</p></div><<>><p"), (5, "http://h", deep), (5, "http://h", deep), (6, "http://h", "<article>" + "<p>long</p>" * 20_000)]
    got = T.extract_pages(pages(spark, rows)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 8 and by[None] == "" and by[1] == "" and by[2] == "no tags at all" and by[3] == "cut off in a" and by[5] == "deep" and by[6].count("\n") == 19_999
    assert all(r.n_chars == len(r.text) for r in got)


def test_equal_vectors_share_a_class():
    rows = [("html", 7, 4, 1, 0, 0), ("html/body", 7, 4, 1, 0, 0), ("html/body/article", 7, 4, 1, 900, 0), ("html/body/nav", 7, 4, 1, 40, 40), ("html/body/div.x", 9, 1, 1, 5000, 0)]
    assert T.deduce(rows) == ({"html/body/article"}, set())


def test_doubled_pages_keep_their_classes(spark):
    """Every page twice: the vectors must not cancel, and rare tokens must stay out of the template."""
    one = lambda i: f'<html><body><div id="text"><p>{"word " * 40}{i}</p></div>{"<div id=odd>rare text</div>" if i == 0 else ""}{"<ul><li>x</ul>" if i < 2 else ""}</body></html>'
    once = [(i, f"http://h/{i}", one(i)) for i in range(5)]
    sets = []
    for copies in (1, 2, 3, 4):
        (t,) = T.classes(pages(spark, once * copies)).collect()
        kinds = {}
        for r in t.tokens:
            assert r.sig != 0
            kinds.setdefault(r.sig, set()).add(r.token)
        sets.append(sorted(sorted(k) for k in kinds.values()))
    assert sets[0] == sets[1] == sets[2] == sets[3] and len(sets[0]) == 2
    assert extract(spark, once * 2) == extract(spark, once)


def test_a_class_is_judged_as_a_whole():
    rows = [("html", 7, 8, 1, 0, 0), ("html/body", 7, 8, 1, 0, 0), ("html/body/main", 7, 8, 1, 300, 0), ("html/body/article", 9, 8, 1, 900, 0), ("html/body/div.c", 9, 2, 1, 9000, 0)]
    assert T.deduce(rows) == T.deduce(rows[::-1]) == ({"html/body/main"}, set())


def shop(i, words):
    """Pages without article or telling names: a box that is the same everywhere, the text, and on some pages a longer box of tips."""
    text = " ".join(words.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(60))
    tips = " ".join(words.choice(["amet", "elit", "nunc"]) for _ in range(90))
    lines = "".join(f"<p>{text} {k}</p>" for k in range(1 + i % 3))
    page = f"<html><body><div class=a><h2>About us</h2>{'We sell things to people everywhere. ' * 20}</div><div class=b><h1>Title {i}</h1>{lines}</div>{f'<div class=c><p>{tips}</p><p>{tips}</p><p>{tips}</p></div>' if i % 4 == 1 else ''}</body></html>"
    return page, "\n".join([f"Title {i}", *(f"{text} {k}" for k in range(1 + i % 3))])


def test_classes_decide_what_a_page_alone_cannot(spark):
    r = random.Random(4)
    made = [shop(i, r) for i in range(8)]
    rows = [(i, f"http://shop/{i}", page) for i, (page, _) in enumerate(made)]
    assert extract(spark, rows) == {i: want for i, (_, want) in enumerate(made)}
    alone = extract(spark, [(i, f"http://shop{i}/", page) for i, _, page in rows])
    assert any(alone[i] != want for i, (_, want) in enumerate(made))


def test_disturbed_vectors_change_the_template(spark):
    r = random.Random(4)
    (t,) = T.classes(pages(spark, [(i, f"http://shop/{i}", shop(i, r)[0]) for i in range(8)])).collect()
    rows = [tuple(x[k] for k in ("token", "sig", "support", "most", "chars", "links", "constant")) for x in t.tokens]
    assert T.deduce(rows)[0] == {"html/body/div.b"}
    assert T.deduce([(x[0], k, *x[2:]) for k, x in enumerate(rows)])[0] == {""}  # every vector another: no class, no template
    assert T.deduce([(x[0], 1, *x[2:]) for x in rows])[0] == {""}  # all vectors one: the class is not on equally many pages


def test_small_parts_that_never_change_are_boilerplate(spark):
    one = lambda i: f"<html><body><div class=b><h1>Title {i}</h1><p>{f'word{i} ' * 80}</p><div class=z>Tell all your friends</div><div class=y>Part {i}</div></div></body></html>"
    got = extract(spark, [(i, f"http://z/{i}", one(i)) for i in range(4)])
    assert got[2] == f"Title 2\n{('word2 ' * 80).strip()}\nPart 2"
    same = [(i, f"http://y/{i}", one(7)) for i in range(4)]  # copies of one page: nothing varies, nothing goes
    assert extract(spark, same)[0].split("\n")[2:] == ["Tell all your friends", "Part 7"]


def test_nothing_else_is_dropped(spark):
    page = '<article><header><h1>Title</h1></header><section class="related-work"><p>Earlier work.</p></section><p>Area <math>a*b</math> holds.</p><section id="search"><p>How we searched.</p></section><section class="widget-theory">W</section></article>'
    want = "Title\nEarlier work.\nArea a*b holds.\nHow we searched.\nW"
    assert extract(spark, [(1, "http://h/1", page)])[1] == want
    assert extract(spark, [(i, f"http://h/{i}", f"<html><body><header>Site</header>{page}<footer>x</footer></body></html>") for i in range(3)]) == dict.fromkeys(range(3), want)


def test_media_of_documents(spark):
    ddl = "doc_id bigint, text string, digest string, feature int"
    docs = [(1, "abc"), (2, ""), (3, None), (4, "é" * 40), (5, "x" * 64), (6, "x" * 65), (7, "abc"), (None, "abc"), (7, "abc"), (8, "long " * 50_000)]
    got = M.document_media(spark.createDataFrame([(i, t, "d", 1) for i, t in docs], ddl)).collect()
    assert len(got) == len(docs)
    for r in got:
        t = next(t for i, t in docs if i == r.doc_id)
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        wav = M.wav(pay)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert len({r.feature for r in got if r.n_bytes == 3}) == 1
    assert M.document_media(spark.createDataFrame([], ddl)).count() == 0


def test_media_bytes_are_stored(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(M, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    got = M.document_media(spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "doc_id bigint, text string")).collect()
    stored = {r.digest: bytes(r.media) for r in tables["media"].collect()}
    assert stored == {hashlib.sha256(x).hexdigest(): M.wav(M.padded(x)) for x in (b"abc", b"")}
    assert {r.media_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in stored.values()}


def test_wav_is_read_by_the_standard_library():
    import io
    import wave

    for pay in (bytes(range(64)), b"\x00" * 128):
        with wave.open(io.BytesIO(M.wav(pay))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, pay)
        assert M.samples(M.wav(pay)) == pay
    data = M.wav(b"ab" * 32)
    chunk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert M.samples(data[:12] + chunk + data[12:]) == b"ab" * 32


def test_sequences_stay_aligned(spark):
    a, b = (hashlib.sha256(x).hexdigest() for x in (b"one", b"two"))
    page = f'<p>before &amp; after</p><figure><img src="sha256:{a}"><figcaption>first <i>picture</i></figcaption></figure><p>middle</p><audio src=\'sha256:{b}\' alt="sound"></audio><img src="http://elsewhere"><img src="sha256:{a}">end'
    items = M.sequence(page)
    assert [(i["kind"], i["text"]) for i in items] == [("text", "before & after"), ("media", "first picture"), ("text", "middle"), ("media", "sound"), ("media", None), ("text", "end")]
    seq = M.interleave(spark.createDataFrame([(1, page), (2, None), (3, "<img src='sha256:00'>")], "key bigint, html string"))
    store = M.store_media(spark.createDataFrame([(b"one",), (b"two",), (b"one",), (None,)], "payload binary"))
    assert store.count() == 3
    rows = M.resolve(seq, store).collect()
    got = sorted((r.key, r.position, r.media is not None, r.digest) for r in rows)
    assert got == [(1, 1, True, a), (1, 3, True, b), (1, 4, True, a), (3, 0, False, "00")]
    assert {(r.key, r.n_items, r.text_chars) for r in rows} == {(1, 6, len("before & aftermiddleend")), (3, 1, 0)} and len({r.sequence for r in rows}) == 2


def test_documents_are_interleaved(spark):
    docs = [(1, "head <b>\nbody  of\ntext"), (2, "one line"), (3, "\nonly below"), (4, None), (1, "head <b>\nbody  of\ntext")]
    rows = [(i, t, "d", 1) for i, t in docs]
    got = [(r.doc_id, r.n_items, r.text_chars, r.positions, r.captions) for r in M.document_media(spark.createDataFrame(rows, "doc_id bigint, text string, digest string, sequence int")).collect()]
    assert sorted(got) == [(1, 4, 20, "1,3", "22,22 bytes"), (1, 4, 20, "1,3", "22,22 bytes"), (2, 3, 8, "1,2", "8,8 bytes"), (3, 3, 10, "0,2", "11,11 bytes"), (4, 2, 0, "0,1", "0,0 bytes")]


def test_hot_digest_loses_nothing(spark):
    ddl = "doc_id bigint, text string, _salt string, n int"
    rows = [(7 if k % 3 else k, "copied" if k % 2 else f"text {k}", "s", 1) for k in range(1500)]
    got = M.document_media(spark.createDataFrame(rows, ddl)).collect()
    want = sorted((i, len(t), M.feature(M.padded(t.encode()))) for i, t, _, _ in rows)
    assert sorted((r.doc_id, r.n_bytes, r.feature) for r in got) == want


CHAT = "conv_id bigint, turn bigint, role string, text string, said string, before int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], CHAT)


def test_quotes_are_linked_and_dropped(spark):
    rows = [
        (1, 0, "user", "How do I sort?\n\nAnd how do I count?"),
        (1, 1, "a", "Use sort."),
        (1, 2, "b", "Ann wrote:\n> And  how do I COUNT?\n\nUse count.\n> > deeper\nbye"),
        (1, 3, "c", "> Use sort.\nThanks"),
        (1, 4, "d", "> never said\nhm"),
        (1, 5, "user", "no quote"),
        (2, 0, "user", "> How do I sort?\nother talk"),
    ]
    got = {(r.conv_id, r.turn): r for r in C.link(chat(spark, rows)).collect()}
    assert {k: r.reply_to for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 3, (1, 5): 4, (2, 0): None}
    assert got[1, 2].said == "Use count.\n\nbye" and got[1, 3].said == "Thanks" and got[1, 0].said == rows[0][3]
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 4].n_linked) == (2, 1, 0)
    c = {r.conv_id: r for r in C.conversations(chat(spark, rows)).collect()}
    assert [m.turn for m in c[1].messages] == [0, 1, 2, 3, 4, 5] and c[1].n_linked == 2


def test_before_over_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 2]), t, "u", "x") for t in range(400)] + [(7, 5, "u", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {(x.conv_id, x.turn): (x.n_before, x.max_before) for x in C.before(chat(spark, rows), ["conv_id"], ["turn"], "turn").collect()}
        parts = C.conversations(chat(spark, rows), segment=50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for c in (None, 1, 2, 7):
        turns = sorted(t for k, t, *_ in rows if k == c)
        for i, t in enumerate(turns):
            assert got[c, t] == (i, turns[i - 1] if i else None)
        mine = sorted((p for p in parts if p.conv_id == c), key=lambda p: p.segment)
        assert [m.turn for p in mine for m in p.messages] == turns and all(p.n_messages <= 50 for p in mine)


def test_odd_chats(spark):
    assert C.conversations(spark.createDataFrame([], CHAT)).count() == 0
    rows = [(None, None, None, None), (None, 1, "u", "> > >"), (3, 1, "u", "same"), (3, 1, "u", "same"), (3, 2, None, "> same\n" + "long " * 20_000)]
    got = {(r.conv_id, r.turn): r for r in C.link(chat(spark, rows)).collect()}
    assert len(got) == 4 and got[3, 2].reply_to == 1 and got[3, 2].n_linked == 1 and got[None, None].said == ""
    plan = C.link(chat(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_messages_of_one_turn_are_all_kept(spark):
    """Null and repeated keys drop no text; links run in the order of turn, role and digest of the text."""
    rows = [(None, 1, "u", f"text {k}") for k in range(5)] + [(4, None, "u", f"no turn {k}") for k in range(5)]
    rows += [(5, 0, "a", "one"), (5, 0, "b", "two"), (5, 0, "b", "two"), (5, 0, "b", None), (5, 1, "c", "> one\nyes"), (5, 2, "d", "plain")]
    linked = C.link(chat(spark, rows)).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.role, r.said) for r in linked) == sorted({(str(c), str(t), r, x or "") if x != "> one\nyes" else ("5", "1", "c", "yes") for c, t, r, x in rows})
    mine = sorted((r for r in linked if r.conv_id == 5), key=lambda r: r.place)
    assert [(r.place, r.turn, r.role, r.said) for r in mine] == [(0, 0, "a", "one"), (1, 0, "b", ""), (2, 0, "b", "two"), (3, 1, "c", "yes"), (4, 2, "d", "plain")]
    assert [(r.reply_place, r.reply_to, r.n_linked) for r in mine] == [(None, None, 0), (0, 0, 0), (1, 0, 0), (0, 0, 1), (3, 1, 0)]
    assert all(r.reply_place is None for r in linked if r.turn is None)
    parts = C.conversations(chat(spark, rows)).collect()
    assert sorted(p.n_messages for p in parts) == [5, 5, 5]
    assert [m.text for p in parts if p.conv_id == 5 for m in p.messages] == ["one", "", "yes", "two", "plain"]


def test_a_line_that_introduces_nothing_stays(spark):
    rows = [(1, 0, "a", "As Ada wrote:\nthe engine weaves."), (1, 1, "b", "As Ada wrote:\nthe engine weaves.\n\nBob wrote:\n\n> the engine weaves.\nyes\nand Eve wrote:"), (1, 2, "c", "> Bob wrote:\n> > the engine weaves.\n> yes\nno")]
    got = {r.turn: r for r in C.link(chat(spark, rows)).collect()}
    assert got[0].said == rows[0][3] and got[1].said == "As Ada wrote:\nthe engine weaves.\n\nyes\nand Eve wrote:" and got[2].said == "no"
    assert (got[1].n_linked, got[1].reply_to, got[2].n_quotes, got[2].n_linked, got[2].reply_to) == (1, 0, 2, 2, 1)


def plain_parse(text):
    """Lines to passages, by a plain loop."""
    rows = []
    for x in re.split(r"\r\n|\r|\n", text or ""):
        marks = re.match(r"(?:[ \t]*>)+", x)
        rows.append((marks[0].count(">") if marks else 0, re.sub(r"^(?:[ \t]*>)+ ?", "", x)))
    kept = []
    for i, (depth, body) in enumerate(rows):
        after = rows[i + 1 :]
        if after and not after[0][1].strip() and after[0][0] <= depth:
            after = after[1:]
        if not (re.search(r"\bwrote\s*:\s*$", body, re.I) and after and after[0][0] > depth):
            kept.append((depth, body))
    out, last = [], None
    for depth, body in kept:
        if not body.strip():
            last = None
        elif last == depth:
            out[-1][1].append(body)
        else:
            out.append((depth, [body]))
            last = depth
    return [(d, "\n".join(b)) for d, b in out]


def plain_link(messages):
    """turn -> (said, quoted passages, linked, turn replied to), by comparing every passage with every earlier message."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    bits = lambda t: {x for x in [*map(norm, t.split("\n")), *re.split(r"(?<=[.!?\u2026])\s+", norm(t))] if x}
    said, out = {}, {}
    for turn, text in messages:
        found = plain_parse(text)
        quoted = [p for p in found if p[0]]
        links = []
        for nth, (depth, q) in enumerate(quoted):
            whole = [t for t, (units, _) in said.items() if norm(q) in units]
            votes = {}
            for part in bits(q):
                if mine := [t for t, (units, _) in said.items() if part in units]:
                    votes[max(mine)] = votes.get(max(mine), 0) + 1
            if whole or votes:
                links.append((-depth, nth, max(whole) if whole else max(votes, key=lambda t: (votes[t], t))))
        own = "\n\n".join(p for d, p in found if not d) if quoted or re.search(r"(?m)^[ \t]*>", text) else text
        units = {norm(own)} | {u for p in re.split(r"\n\s*\n", own) for u in {norm(p)} | bits(p)}
        earlier = max(said, default=None)
        out[turn] = (own, len(quoted), len(links), max(links)[2] if links else earlier)
        said[turn] = (units - {""}, own)
    return out


def test_threads_against_a_plain_search(spark):
    r = random.Random(12)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split())
    sentence = lambda: " ".join(word() for _ in range(r.randrange(1, 6))).capitalize() + r.choice([".", "!", "?", " ..."])
    quote = lambda t: "\n".join(r.choice(["> ", ">", "  > "]) + x if x.strip() else r.choice([">", ""]) for x in t.split("\n"))
    rows, want = [], {}
    for conv in range(25):
        thread = []
        for turn in range(r.randrange(2, 9)):
            own = "\n\n".join("\n".join(" ".join(sentence() for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 3)))
            cited = []
            for _ in range(r.randrange(3) if thread else 0):
                full = r.choice(thread)[1]
                mode = r.randrange(5)
                text = full if mode == 0 else r.choice(full.split("\n")) if mode == 1 else "\n".join(full.split("\n")[: r.randrange(1, 4)]) if mode == 2 else " ".join(full.split()) if mode == 3 else full.replace(". ", ".\n").upper()
                cited.append(r.choice(["", "Somebody wrote:\n", "Somebody wrote:\n\n"]) + quote(text))
            pieces = [*cited, own]
            r.shuffle(pieces)
            thread.append((turn, r.choice(["\n", "\n\n", "\r\n"]).join(pieces)))
        rows += [(conv, t, "u", x) for t, x in thread]
        want |= {(conv, t): v for t, v in plain_link(thread).items()}
    got = {(x.conv_id, x.turn): (x.said, x.n_quotes, x.n_linked, x.reply_to) for x in C.link(chat(spark, rows)).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 60
