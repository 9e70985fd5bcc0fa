"""Main-text extraction by wrappers inferred from the pages of a host.

A page is a stream of container tags and blocks of text.  Per host, the streams of all its pages are
aligned one after the other into a wrapper, a union-free regular expression kept as a tree: a text that
differs between pages becomes a slot, an element that some pages lack becomes optional, equal neighbours
become one repeated group, and a page that shares less than half of its elements with every wrapper so far
starts another.  A host's pages are dealt over parts by their digests; the parts' wrappers are aligned in
turn.  Every page is then parsed by the wrapper it fits best.  Its main
text is what lies in the article element, or where it has none in the wrapper's main region, the element
below which the slots hold the running text; texts that the wrapper knows as constant are left out, unless
nothing else is left.  Names (tags, whole class, id and role names) say what inside the region is not
main text, and choose where slots do not.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([\w-]+)")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements and class words of what is not main text.
OUTSIDE = frozenset(
    "aside audio button canvas dialog footer form head header iframe input menu nav noscript object option script select style svg "
    "template textarea title video".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login "
    "masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related replies reply search share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
OUTSIDE_ROLES = frozenset("alert banner complementary contentinfo dialog navigation search".split())
#: A class name such as "site-footer" counts by its last part, unless it says that the page has none or some.
NOT_ITSELF = frozenset("has have no not with without show hide".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Settings:
    """Levels of a page that shows its wrapper's elements (a deeper one shows nothing); different pages that
    show a constant text, and how many are noted at an element; wrappers of a host (a page unlike all of so
    many goes to the one most alike) and kids of an element that are told apart; parts that a host's pages
    are dealt over; bytes of wrappers that are broadcast (more are joined by shuffle).  Wrappers are fitted
    on every page and every page is parsed, however long."""

    depth: int = 100
    least_pages: int = 3
    noted_pages: int = 8
    most_wrappers: int = 24
    most_kids: int = 512
    parts: int = 64
    broadcast_bytes: int = 8 << 20


def _outside_name(name: str) -> bool:
    *first, last = re.findall(r"[a-z]+", name) or [""]
    return last in OUTSIDE_WORDS and NOT_ITSELF.isdisjoint(first)


def _container(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, outside main text, holds main text) of an element."""
    found = {m[1].lower() if m[1] else m[5].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    outside = tag in OUTSIDE or role in OUTSIDE_ROLES or hidden or any(map(_outside_name, names))
    words = sorted({w for n in names for w in re.findall(r"[a-z]+", n)})
    return ".".join([tag, *words[:4], *(["!"] if hidden or role in OUTSIDE_ROLES else [])]), outside, tag in ARTICLE or role in ("main", "article")


def events(html: str) -> Iterator[tuple]:
    """The page as a stream: ("open", label, outside, main), ("text", text, characters inside links, in a
    heading) and ("close",).

    Only closed block elements are containers, and of the inline ones those that are never text (scripts,
    buttons and the like) or hidden; paragraphs only end a text.
    """
    tokens = [m for m in TOKEN.finditer(html)]
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    unclosed: Counter = Counter()
    for i, m in enumerate(tokens):
        tag = m[3] and m[3].lower()
        if not tag or tag in VOID or m[0].endswith("/>"):
            continue
        if not m[2]:
            stack.append((tag, i))
            unclosed[tag] += 1
        elif unclosed[tag]:
            while True:
                t, at = stack.pop()
                unclosed[t] -= 1
                if t == tag:
                    ends[at] = i
                    break
    upto: list[int] = []
    text: list[str] = []
    linked = links = 0
    headings = 0
    marks: list[tuple[int, str]] = []  # ends of links and headings

    def flush():
        nonlocal links
        said = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if said:
            yield "text", said, min(links, len(said)), headings > 0
        links = 0

    for i, m in enumerate(tokens):
        while upto and upto[-1] <= i:
            yield from flush()
            yield ("close",)
            upto.pop()
        while marks and marks[-1][0] <= i:
            if marks.pop()[1] == "a":
                linked -= 1
            else:
                yield from flush()
                headings -= 1
        tag = m[3] and m[3].lower()
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
                links += len(m[0]) if linked else 0
            continue
        block = tag in BLOCK or tag in OUTSIDE
        if tag == "br":
            text.append(" ")
        elif block:
            yield from flush()
        if m[2] or i not in ends:
            continue
        if tag == "a" or tag in HEADINGS:
            marks.append((ends[i], "a" if tag == "a" else "h"))
            linked += tag == "a"
            headings += tag != "a"
        elif block and tag not in ("p", "body", "html"):
            yield ("open", *_container(tag, m[4] or ""))
            upto.append(ends[i])
        elif not block and m[4] and m[4].strip():
            label, _, _ = _container(tag, m[4])
            if label.endswith("!"):
                yield from flush()
                yield "open", label, True, False
                upto.append(ends[i])
    yield from flush()
    while upto:
        upto.pop()
        yield ("close",)


# ------------------------------------------------------------ wrappers
# A node is [label, kids, repeated, pages, crc, slot characters, link characters, heading, outside, main, noted];
# a text has the label "#" and a crc, None once it is a slot.  ``noted`` are the digests of pages that show it,
# none a copy of another, ``pages`` their number.  The label "*" is for what is counted without a place.

LABEL, KIDS, REPEATED, PAGES, CRC, CHARS, LINKS, HEADING, OUT, MAIN, NOTED = range(11)
#: By digest, the crcs of a page's texts that no outside name covers.
Texts = dict[str, frozenset[int]]


def _node(label: str, digest: str, out: bool = False, main: bool = False) -> list:
    return [label, [], False, 1, None, 0, 0, False, out, main, [digest]]


def tree(html: str, digest: str, s: Settings) -> tuple[list, Texts] | None:
    """The page as a tree with repeated neighbours folded, and its texts; None when it is too deep or says nothing."""
    root = _node("", digest)
    stack, said, outside = [root], set(), 0
    texts: Texts = {digest: frozenset()}
    for e in events(html):
        if e[0] == "open":
            if len(stack) > s.depth:
                return None
            stack.append(_node(e[1], digest, e[2], e[3]))
            outside += e[2]
        elif e[0] == "close":
            node = stack.pop()
            outside -= node[OUT]
            node[KIDS] = _told_apart(node[KIDS], texts, s)
            _append(stack[-1][KIDS], node, texts, s)
        else:
            crc = zlib.crc32(e[1].encode("utf-8", "replace"))
            _append(stack[-1][KIDS], ["#", [], False, 1, crc, len(e[1]), e[2], e[3], False, False, [digest]], texts, s)
            if not outside:
                said.add(crc)
    root[KIDS] = _told_apart(root[KIDS], texts, s)
    return (root, {digest: frozenset(said)}) if said else None


def _shape(node: list):
    return node[LABEL], tuple(_shape(k) for k in node[KIDS])


def _append(kids: list[list], node: list, texts: Texts, s: Settings) -> None:
    """Add a sibling; one like its neighbour makes that a repeated group."""
    last = kids[-1] if kids else None
    if last is not None and last[LABEL] == node[LABEL] and last[HEADING] == node[HEADING] and _shape(last) == _shape(node):
        kids[-1] = _merge(last, node, texts, s)
        kids[-1][REPEATED] = True
    else:
        kids.append(node)


def _copies(a: frozenset[int], b: frozenset[int]) -> bool:
    """Whether two pages have more than half of the larger one's texts in common."""
    return 2 * len(a & b) > max(len(a), len(b))


def _noted(a: list[str], b: list[str], texts: Texts, s: Settings) -> list[str]:
    """Digests of pages of both lists, none a copy of another."""
    if a == b or len(a) >= s.noted_pages:
        return a
    out = list(a)
    for d in b:
        if len(out) < s.noted_pages and d not in out and not any(_copies(texts[d], texts[o]) for o in out):
            out.append(d)
    return out


def _merge(a: list, b: list, texts: Texts, s: Settings) -> list:
    """Two nodes of one label as one."""
    out = list(a)
    out[REPEATED] = a[REPEATED] or b[REPEATED]
    out[NOTED] = _noted(a[NOTED], b[NOTED], texts, s)
    out[PAGES] = len(out[NOTED])
    out[CRC] = a[CRC] if a[CRC] == b[CRC] else None
    out[CHARS], out[LINKS] = a[CHARS] + b[CHARS], a[LINKS] + b[LINKS]
    out[HEADING] = a[HEADING] or b[HEADING]
    out[KIDS] = _align(a[KIDS], b[KIDS], texts, s)
    return out


def _align(a: list[list], b: list[list], texts: Texts, s: Settings) -> list[list]:
    """Sibling streams aligned by their longest common runs of labels: common ones merge, others are optional."""
    names = [[(k[LABEL], k[HEADING]) for k in kids] for kids in (a, b)]
    if names[0] == names[1]:
        return [_merge(x, y, texts, s) for x, y in zip(a, b)]
    out: list[list] = []
    for op, i, j, k, l in SequenceMatcher(None, *names, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merge(x, y, texts, s) for x, y in zip(a[i:j], b[k:l])]
        else:
            for node in [*a[i:j], *b[k:l]]:
                _append(out, node, texts, s)
    return _told_apart(out, texts, s)


def _told_apart(kids: list[list], texts: Texts, s: Settings) -> list[list]:
    """``kids``, or where they are too many to align one by one, those of one label as one repeated group;
    labels beyond that (names that change from page to page), those on the fewest pages first, are only counted."""
    if len(kids) <= s.most_kids:
        return kids
    by: dict[tuple, list] = {}
    for k in kids:
        key = k[LABEL], k[HEADING] and k[LABEL] != "*"
        if key in by:
            by[key] = _merge(by[key], k, texts, s)
            by[key][REPEATED] = True
        else:
            by[key] = k
    out = list(by.values())
    if len(out) <= s.most_kids:
        return out
    places = sorted(range(len(out)), key=lambda i: (out[i][LABEL] == "*", -out[i][PAGES], i))
    kept = sorted(places[: s.most_kids // 2])
    rest = ["*", [], True, 1, None, 0, 0, False, False, False, []]
    for i in sorted(places[s.most_kids // 2:]):
        chars, links, heading = _slots(out[i], s.least_pages)
        rest[CHARS] += chars
        rest[LINKS] += links
        rest[HEADING] |= heading
    return [*(out[i] for i in kept), rest]


def _alike(wrapper: list, page: list) -> float:
    """Share of the page's elements that the wrapper has at the same place by labels."""
    seen = total = 0
    stack = [(wrapper, page)]
    while stack:
        w, p = stack.pop()
        by = {(k[LABEL], k[HEADING]): k for k in w[KIDS]} if w else {}
        for k in p[KIDS]:
            total += 1
            other = by.get((k[LABEL], k[HEADING]))
            seen += other is not None
            stack.append((other, k))
    return seen / total if total else 1.0


class Fit:
    """The wrappers of the pages seen so far, with the texts of the pages noted in them."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.wrappers: list[list] = []
        self.texts: Texts = {}
        self.most_texts = 1_000

    def add(self, root: list, texts: Texts, of_page: bool = True) -> None:
        """Align a page's tree, or another fit's wrapper, with the wrapper most alike."""
        s = self.settings
        self.texts.update(texts)
        scores = [_alike(w, root) if of_page else max(_alike(w, root), _alike(root, w)) for w in self.wrappers]
        best = max(range(len(scores)), key=scores.__getitem__, default=None)
        if best is None or (scores[best] < 0.5 and len(scores) < s.most_wrappers):
            self.wrappers.append(root)
        else:
            self.wrappers[best] = _merge(self.wrappers[best], root, self.texts, s)
        if len(self.texts) > self.most_texts:
            self.forget()
            self.most_texts = max(1_000, 2 * len(self.texts))

    def forget(self) -> None:
        """Drop the texts of pages that no element notes."""
        held: set[str] = set()
        stack = list(self.wrappers)
        while stack:
            node = stack.pop()
            held.update(node[NOTED])
            stack += node[KIDS]
        self.texts = {d: t for d, t in self.texts.items() if d in held}

    def written(self) -> str:
        self.forget()
        return json.dumps([self.wrappers, {d: sorted(t) for d, t in self.texts.items()}])


def _read(written: str) -> tuple[list[list], Texts]:
    roots, texts = json.loads(written)
    return roots, {d: frozenset(t) for d, t in texts.items()}


def infer(pages: list[str], settings: Settings) -> list[list]:
    """The wrappers of a host from its pages.  A page that is a copy of another counts once at every element."""
    fit = Fit(settings)
    for html in pages:
        made = tree(html, hashlib.md5(html.encode("utf-8", "replace")).hexdigest(), settings)
        if made is not None:
            fit.add(*made)
    return fit.wrappers


def _slots(node: list, least: int) -> tuple[int, int, bool]:
    """(characters, those in links, any heading) of the slots below a node, what names put outside left out."""
    if node[LABEL] in ("#", "*"):
        constant = node[CRC] is not None and node[PAGES] >= least
        return (0, 0, False) if constant else (node[CHARS], node[LINKS], node[HEADING])
    if node[OUT]:
        return 0, 0, False
    below = [_slots(k, least) for k in node[KIDS]]
    return sum(b[0] for b in below), sum(b[1] for b in below), any(b[2] for b in below)


def main_region(wrapper: list, least: int) -> list:
    """The element below which the slots hold the running text: from the root down into the fullest
    element, as long as all others hold links mostly, or no heading and under a tenth of the text."""
    node = wrapper
    while True:
        sizes = [_slots(k, least) for k in node[KIDS]]
        total = sum(s[0] for s in sizes)
        if not total or node[MAIN]:
            return node
        best = max(range(len(sizes)), key=lambda i: sizes[i][0] - sizes[i][1])
        others = [s for i, s in enumerate(sizes) if i != best and s[0]]
        if node[KIDS][best][LABEL] in ("#", "*") or not all(2 * n >= s or (10 * s < total and not h) for s, n, h in others):
            return node
        node = node[KIDS][best]


class Parser:
    """A wrapper made ready for parsing pages: kids by label, the main region, the constant texts."""

    def __init__(self, wrapper: list, least: int):
        self.region = main_region(wrapper, least)
        self.root = wrapper
        self.least = least
        self.places: dict[int, dict] = {}

    def kid(self, node: list | None, at: int, label: str, heading: bool) -> tuple[list | None, int]:
        """The next kid of the label from place ``at`` on, else the last before it; and the place after it."""
        if node is None:
            return None, at
        places = self.places.get(id(node))
        if places is None:
            places = self.places[id(node)] = {}
            for i, k in enumerate(node[KIDS]):
                places.setdefault((k[LABEL], k[HEADING] if k[LABEL] == "#" else False), []).append(i)
        found = places.get((label, heading))
        if not found:
            return None, at
        i = bisect_left(found, at)
        if i == len(found):
            return node[KIDS][found[-1]], at
        kid = node[KIDS][found[i]]
        return kid, found[i] + (not kid[REPEATED])


def parse(page: list[tuple], parser: Parser | None) -> tuple[float, list[tuple[int, bool, str]]]:
    """(share of the texts that the wrapper has a place for, (rank, constant, text) of each text).

    Ranks: 4 in an article, 3 in an article inside something outside, 2 in the wrapper's main region,
    1 not outside, 0 outside.
    """
    out, fits, texts = [], 0, 0
    # wrapper node, place in it, outside so far, article (1 clean, 2 inside something outside), in the region, an article's own header
    stack = [(parser.root if parser else None, 0, False, 0, parser is not None and parser.region is parser.root, False)]
    for e in page:
        node, at, outside, article, region, header = stack[-1]
        if e[0] == "open":
            kid, at = parser.kid(node, at, e[1], False) if parser else (None, 0)
            stack[-1] = node, at, outside, article, region, header
            own = article and not outside and e[1].split(".")[0] == "header"
            if e[3] and not article:
                article, outside = 2 if outside else 1, False
                if e[2] and e[1].split(".")[0] not in ARTICLE:
                    outside = True
            else:
                outside = outside or (e[2] and not own)
            stack.append((kid, 0, outside, article, region or (kid is not None and kid is parser.region), header or own))
        elif e[0] == "close":
            stack.pop()
        else:
            kid, at = parser.kid(node, at, "#", e[3]) if parser else (None, 0)
            stack[-1] = node, at, outside, article, region, header
            texts += 1
            fits += kid is not None
            constant = (kid is not None and kid[CRC] is not None and kid[PAGES] >= parser.least
                        and kid[CRC] == zlib.crc32(e[1].encode("utf-8", "replace")))
            cut = outside or (header and not e[3])  # of an article's own header only the headings
            out.append((0 if cut else (0, 4, 3)[article] or (2 if region else 1), constant, e[1]))
    return fits / texts if texts else 1.0, out


def main_text(html: str, parsers: list[Parser]) -> str:
    """The page's main text by the wrapper that fits it best, by itself where none has half of its texts."""
    page = list(events(html))
    tried = [parse(page, p) for p in parsers]
    share, said = max(tried, key=lambda t: t[0], default=(0.0, []))
    if share < 0.5:
        _, said = parse(page, None)
    rank = max((r for r, _, _ in said), default=0)
    if not rank:
        return ""
    keep = [(c, t) for r, c, t in said if r == rank]
    return "\n".join([t for c, t in keep if not c] or [t for _, t in keep])


def wrappers(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, wrappers): the wrappers of each host as JSON, fitted on all its pages.

    Pages become trees, which hold labels and crcs, no texts; those of a host are dealt over parts by their
    digests, aligned in the order of these, and the parts' wrappers in the order of the parts, so that the
    result does not depend on where the rows lie."""
    s = settings
    rows = pages.select(host_of().alias("host"), "html").filter(F.length("html") > 0).withColumn("digest", F.md5("html"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree(html.as_py(), digest.as_py(), s) for html, digest in zip(batch.column("html"), batch.column("digest"))]
            known = [m is not None for m in made]
            shown = [json.dumps([[root], {d: sorted(t) for d, t in texts.items()}]) for root, texts in filter(None, made)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(known, pa.bool_())) for c in ("host", "digest")] + [pa.array(shown, pa.string())],
                                             names=["host", "digest", "wrappers"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, made = None, None, Fit(s)  # host and part, digest, their wrappers

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([made.written()], pa.string())],
                                              names=["host", "part", "wrappers"])

        for batch in batches:
            for host, part, digest, shown in zip(*(batch.column(c) for c in ("host", "part", "digest", "wrappers"))):
                key, digest = (host.as_py(), part.as_py()), digest.as_py()
                if key != now:
                    if now is not None:
                        yield done()
                    now, last, made = key, None, Fit(s)
                if digest != last:  # an exact copy shows nothing new
                    (root,), texts = _read(shown.as_py())
                    made.add(root, texts)
                last = digest
        if now is not None:
            yield done()

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:  # at most ``parts`` rows
        made = Fit(s)
        for shown in group.sort_values("part")["wrappers"]:
            roots, texts = _read(shown)
            for root in roots:
                made.add(root, texts, of_page=False)
        return pd.DataFrame({"host": [key[0]], "wrappers": [json.dumps([_without_notes(w) for w in made.wrappers])]})

    part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(s.parts)).cast("int")
    shown = (rows.mapInArrow(trees, "host string, digest string, wrappers string").withColumn("part", part)
             .select("host", "part", "digest", "wrappers").repartition("host", "part").sortWithinPartitions("host", "part", "digest"))
    return (shown.mapInArrow(fit, "host string, part int, wrappers string")
            .groupBy("host").applyInPandas(join, "host string, wrappers string"))


def _without_notes(node: list) -> list:
    return [*node[:KIDS], [_without_notes(k) for k in node[KIDS]], *node[KIDS + 1: NOTED]]


def host_of():
    """The url's host; urls without one share the empty host."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), F.lit(""))


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    White space in a block becomes one space, blocks are joined by a line feed.  A null or empty
    html, or one without main text, gives an empty text; a null url belongs to the empty host.  Copies of a
    page count once in its wrapper, and a host's only page is its own wrapper, in which every text is a slot.
    Repeated rows give repeated results; other columns are ignored.
    """
    s = settings
    rules = stored(wrappers(pages, s), "wrappers")
    size = rules.agg(F.sum(F.length("host") + F.length("wrappers"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    joined = rows.join(F.broadcast(rules) if size <= s.broadcast_bytes else rules, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Parser]] = {}
        for batch in batches:
            texts = []
            for host, html, made in zip(batch.column("host"), batch.column("html"), batch.column("wrappers")):
                host = host.as_py()
                if host not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    known[host] = [Parser(w, s.least_pages) for w in json.loads(made.as_py() or "[]")]
                texts.append(main_text(html.as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")
