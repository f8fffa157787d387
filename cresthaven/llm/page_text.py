"""Main text of web pages by equivalence-class template deduction.

1. A page's tokens are its element openings, told apart by their path of containers.  For every host, Spark adds up each
   token's occurrence vector over the host's pages as a digest (sums of hashed page and count, which repeated pages do
   not cancel), so tokens with equal vectors share a digest; they form an equivalence class.
2. A class is valid if it has two tokens or more, all on equally many pages, at least half of the host's.  Valid classes
   nest: a token counts only where the element it stands in belongs to a valid class too.  The tokens that are once on
   each of their pages are the host's template.
3. Its slots are the contents of the template's elements without those of the template's elements in them; what varies
   in number (paragraphs, list items, whole classes of other vectors) falls into the slot around it.  The slot with the
   most text outside links is the main one.  It grows to the article or, without one, to the elements around it as long
   as what these add is neither links nor the same on every page.
4. Of the main element the text is taken, without what page elements by their kind say is no article (see ``NO_TEXT``),
   and without the template's elements in it that say the same on every page and are small beside it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, written

BROADCAST_BYTES = 32 << 20  # of host templates (paths of main and left out elements) up to which they are broadcast
DEEPEST = 64  # elements nested deeper belong to the path of the one at this depth
LEAST_SIZE = 2  # tokens that make a class
TOKENS = pa.schema([("host", pa.string()), ("token", pa.string()), ("page", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("said", pa.int64())])
TEMPLATES = pa.schema([("host", pa.string()), ("main", pa.list_(pa.string())), ("out", pa.list_(pa.string()))])
RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

RAW = "script|style|noscript|template|textarea|title|iframe|select|option|button"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
CONTAINERS = set("html head body nav header footer aside main article section div form fieldset dialog menu ul ol dl table figure details address".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption blockquote pre hr thead tbody tfoot summary legend center".split())
# Elements that are no article by their kind; a header is one unless it heads an article or section.
NO_TEXT = set("head nav footer aside form fieldset dialog menu".split())
HEADED = set("article main section".split())
# Whole class, id or role words by which pages name adverts, side parts, notices and reader comments.
NAMED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead notice notices cookie cookies consent comment comments disqus replies newsletter subscribe popup modal share sharing social complementary contentinfo hidden".split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def name_of(tag: str, attributes: str) -> str:
    """The element's name in paths: its tag and the words of class, id and role; runs of digits (numbered ids) count as one 0."""
    if not attributes:
        return tag
    words = [" ".join(v or "" for v in (a, b, c)).strip() or k for k, a, b, c in _ATTRIBUTE.findall(attributes)]
    return tag + _DIGITS.sub("0", "".join("." + ".".join(w.replace("/", "|").split()) for w in words))


def no_text(name: str, inside: list[str]) -> bool:
    """Whether an element, by its kind or name, is no part of an article; ``inside``: the tags around it."""
    tag, _, words = name.partition(".")
    if tag in NO_TEXT or tag == "header" and not HEADED.intersection(inside):
        return True
    return bool(words) and tag not in ("html", "body") and not NAMED.isdisjoint(words.lower().split("."))


def walk(page: str):
    """Yield ("open", path, depth of no-text elements, ...), ("block", ...) at block ends and ("text", path, depth, raw text, in a link) in page order."""
    stack: list[tuple[str, str, bool]] = []  # path, tag, no text
    tags: list[str] = []
    link = at = out = 0
    path = ""
    for m in _TAG.finditer(page):
        if m.start() > at:
            yield "text", path, out, page[at : m.start()], link
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closing = bool(m[2])
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            yield "text", path, out, " ", 0
        if tag in BLOCKS:
            yield "block", path, out, None, 0
            if tag in CONTAINERS:
                link = 0
                if closing:
                    if tag in tags:
                        cut = len(tags) - 1 - tags[::-1].index(tag)
                        out -= sum(s[2] for s in stack[cut:])
                        del tags[cut:], stack[cut:]
                else:
                    name = name_of(tag, m[4])
                    hidden = no_text(name, tags)
                    deep = len(stack) >= DEEPEST
                    stack.append((path if deep else f"{path}/{name}" if path else name, tag, hidden))
                    tags.append(tag)
                    out += hidden
                path = stack[-1][0] if stack else ""
            if not closing:
                yield "open", path if tag in CONTAINERS else f"{path}/{tag}", out, tag, 0
    if at < len(page):
        yield "text", path, out, page[at:], link


def tokens(page: str) -> dict[str, list[int]]:
    """token -> [occurrences, characters of text in it and in what it holds, of these in links, digest of that text]; text of no article does not count."""
    own: dict[str, list] = {}
    for kind, path, out, what, link in walk(page):
        if kind == "open":
            own.setdefault(path, [0, 0, 0, 0])[0] += 1
        elif kind == "text" and not out and (t := what.strip()):
            o = own.setdefault(path, [0, 0, 0, 0])
            o[1] += len(t)
            o[2] += len(t) * link
            o[3] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), o[3])
    for path in sorted(own, key=lambda p: -p.count("/")):  # from the leaves up
        if "/" in path and own[path][1]:
            up = own.setdefault(path.rpartition("/")[0], [0, 0, 0, 0])
            up[1] += own[path][1]
            up[2] += own[path][2]
            up[3] = (up[3] + own[path][3] * 31) % 2**63
    for v in own.values():
        v[3] %= 2**63
    return own


def _container(token: str) -> bool:
    return token.rpartition("/")[2].partition(".")[0] in CONTAINERS


def template(rows: list[tuple]) -> set[str]:
    """(token, sig, support, most, ...) of a host -> the tokens of its template: those of valid, nesting classes, once on each page.

    A page by itself has no vectors to compare: there every token that occurs once belongs.
    """
    pages = max((r[2] for r in rows), default=0)
    classes: dict[int, list[tuple]] = {}
    for r in rows:
        classes.setdefault(r[1], []).append(r)
    least = LEAST_SIZE if pages > 1 else 1
    valid = {r[0] for c in classes.values() if len(c) >= least and min(r[2] for r in c) * 2 >= pages and len({r[2] for r in c}) == 1 for r in c if r[3] == 1}
    kept: set[str] = set()
    for t in sorted(valid, key=lambda t: t.count("/")):
        if "/" not in t or t.rpartition("/")[0] in kept:
            kept.add(t)
    return kept


def deduce(rows: list[tuple]) -> tuple[set[str], set[str]]:
    """(token, sig, support, most, chars, links[, constant]) of a host -> (path of the main element, paths of what in it is boilerplate).

    ``chars`` and ``links`` hold what is in the token's element; ``constant``: the same text on every page.  Without a
    template, or without text in it, the main element is the whole page ('').
    """
    kept = template(rows)
    slots = {r[0]: r for r in rows if r[0] in kept and _container(r[0])}
    inside: dict[str, list[str]] = {t: [] for t in slots}
    for t in slots:
        if (up := t.rpartition("/")[0]) in inside:
            inside[up].append(t)
    plain = lambda t: slots[t][4] - 2 * slots[t][5]
    constant = lambda t: len(slots[t]) > 6 and bool(slots[t][6])
    all_same = all(constant(t) for t in slots)
    mass = {t: plain(t) - sum(plain(u) for u in inside[t] if plain(u) > 0) - (0 if all_same or not constant(t) else plain(t)) for t in slots}
    best = max(slots, key=lambda t: (mass[t], t.count("/"), t), default="")
    if not best or mass[best] <= 0:
        return {""}, set()
    path = best.split("/")
    around = ["/".join(path[:k]) for k in range(len(path), 0, -1)]
    main = next((t for kind in ("article", "main") for t in around if t.rpartition("/")[2].partition(".")[0] == kind), None)
    if main is None:
        main = best
        for t in around[1:]:
            if t in ("html", "body", "html/body"):
                break
            others = [u for u in inside[t] if u != main and slots[u][4]]
            if any(plain(u) <= 0 or constant(u) and not all_same for u in others):
                break
            main = t
    small = set()
    if not all_same and not constant(main):
        todo = list(inside.get(main, ()))
        while todo:
            t = todo.pop()
            if constant(t) and 0 < slots[t][4] * 10 < slots[main][4]:
                small.add(t)
            else:
                todo += inside[t]
    return {main}, small


def own_template(page: str) -> list[tuple]:
    return [(t, n, 1, n, c, k, False) for t, (n, c, k, _) in tokens(page).items()]


def extract(page: str, main: set[str], out: set[str] = frozenset()) -> str:
    """The main element's blocks, one a line.  A page without that element is taken as its own template."""
    found = _extract(page, main, out) if main else None
    if found is None:
        found = _extract(page, *deduce(own_template(page)))
    return found or ""


def _extract(page: str, main: set[str], out: set[str]) -> str | None:
    blocks: list[list[str]] = [[]]
    inside: dict[str, bool] = {}
    seen = "" in main
    for kind, path, hidden, what, _ in walk(page):
        if path in main:
            seen = True
        if kind == "text":
            if path not in inside:
                parts = path.split("/")
                up = {"/".join(parts[:k]) for k in range(1, len(parts) + 1)} | {""}
                inside[path] = not main.isdisjoint(up) and out.isdisjoint(up)
            if inside[path] and not hidden:
                blocks[-1].append(what)
        elif blocks[-1]:
            blocks.append([])
    if not seen:
        return None
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _token_rows(batches):
    for b in batches:
        urls, pages = b.column("url").to_pylist(), b.column("html").to_pylist()
        for at in range(0, len(pages), 256):
            out: list[list] = [[] for _ in TOKENS]
            for url, page in zip(urls[at : at + 256], pages[at : at + 256]):
                host, key = host_of(url), xxhash.xxh64_intdigest(f"{url}\n{page}".encode("utf-8", "surrogatepass"), 1) - 2**63
                for token, values in tokens(page or "").items():
                    for c, v in zip(out, (host, token, key, *values)):
                        c.append(v)
            yield batch(TOKENS, *out)


def _deduced(batches):
    for b in batches:
        out: list[list] = [[], [], []]
        for host, rows in zip(b.column("host").to_pylist(), b.column("tokens")):
            main, small = deduce([tuple(r[k] for k in ("token", "sig", "support", "most", "chars", "links", "constant")) for r in rows.as_py()])
            for c, v in zip(out, (host, sorted(main), sorted(small))):
                c.append(v)
        yield batch(TEMPLATES, *out)


def classes(pages: DataFrame) -> DataFrame:
    """(url, html) -> a row per host with two rows or more: host, tokens (array of token, sig, support, most, chars, links, constant).

    Only tokens on at least a quarter of the host's pages are kept, which bounds a host's row; sums are partial
    before the shuffle, so a host with very many pages is no hot key.
    """
    rows = pages.select("url", "html").mapInArrow(_token_rows, "host string, token string, page bigint, n bigint, chars bigint, links bigint, said bigint")
    # the two halves are summed apart: no overflow for 2^31 pages of a host
    seen = F.xxhash64("page", "n")
    sums = [F.count("*").alias("support"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("said") == F.max("said")).alias("constant")]
    each = rows.groupBy("host", "token").agg(F.xxhash64(F.sum(F.shiftright(seen, 32)), F.sum(seen.bitwiseAND(0xFFFFFFFF))).alias("sig"), *sums)
    each = written(each, "tokens")
    most = each.groupBy("host").agg(F.max("support").alias("pages")).where("pages > 1")
    kept = each.join(most, "host").where("support * 4 >= pages")
    return kept.groupBy("host").agg(F.collect_list(F.struct("token", "sig", "support", "most", "chars", "links", "constant")).alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """(url, html) -> a row per host with two rows or more: host, main, out (paths of elements, as of ``deduce``)."""
    return classes(pages).mapInArrow(_deduced, "host string, main array<string>, out array<string>")


def _text_rows(batches):
    for b in batches:
        ids, urls, pages, mains, outs = (b.column(c) for c in ("page_id", "url", "html", "main", "out"))
        urls, pages = urls.to_pylist(), pages.to_pylist()
        for at in range(0, len(pages), 256):
            texts = [extract(pages[i] or "", set(mains[i].as_py() or ()), set(outs[i].as_py() or ())) for i in range(at, min(at + 256, len(pages)))]
            yield batch(RESULT, ids.slice(at, 256), urls[at : at + 256], texts, [len(t) for t in texts])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> a row per row: page_id, url, text, n_chars.

    Null html counts as empty and has the text ''; a null url or one without a host shares the host ''.  Ids may be
    null or repeat, rows that repeat count as often as they come; extra columns are ignored; no pages, no rows.  A host
    with one row has no vectors to compare: such a page is its own template.  Templates are broadcast while they have
    at most ``BROADCAST_BYTES``; beyond that pages are joined to them by host, and Spark splits a skewed host.
    """
    own = pages.select("page_id", "url", "html")
    found = written(templates(own), "templates")
    held = lambda c: F.sum(F.length(F.array_join(c, "/"))) + F.sum(F.length("host")) + 64 * F.count("*")
    if (found.agg((held("main") + held("out")).alias("n")).first().n or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    own = own.withColumn("_host", F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    joined = own.join(found, F.col("_host") == F.col("host"), "left").select("page_id", "url", "html", "main", "out")
    return joined.mapInArrow(_text_rows, "page_id bigint, url string, text string, n_chars bigint")
