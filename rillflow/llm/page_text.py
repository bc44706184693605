"""Main text of web pages, with site templates removed.

Every element subtree of a page is hashed: tag, class, id, texts and children. Spark counts, for each host, on how many
pages a subtree recurs among other contents; subtrees that recur on many pages of their host are its template and are
deleted from all of them. What is left of the article is the text: besides templates, elements that name themselves
as something else (menus, footers, adverts, forms, comments and the like) go by tag, role or class.

A recurring subtree counts once for each different rest of its page, so copies of one page are no evidence of a
template. Paragraphs and headings of a marked article are never template: an article may quote what others quote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import islice, takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.tables import cut

#: A template is on ``LEAST_PAGES`` pages of its host, and on ``LEAST_SHARE`` percent of them. The share bounds a host's templates: 20 times the elements of its mean page.
LEAST_PAGES, LEAST_SHARE = 4, 5
#: Bytes of templates that may be broadcast; more are joined by host.
BROADCAST_BYTES = 1 << 25

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text.
FLOW = HEADINGS | frozenset("p pre blockquote li dt dd td th tr tbody thead tfoot caption figcaption center address hgroup".split())
#: A start tag that ends an open element of these tags, and what holds that back.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDS = frozenset("html body table ul ol dl select td th caption button object template article section".split())
P_HOLDS = frozenset("html table td th caption button object template".split())

# What isn't article: tags, roles, and words of class and id.
NOT_TAGS = frozenset("nav footer header aside form select button dialog menu search head fieldset".split()) | RAW
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription toolbar widget".split()
)

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
MASK = (1 << 64) - 1


class Element:
    """An element: where its text nodes begin and end, its parent, its subtree's ``hash``, the sum of its texts' hashes (``own``) and their size.

    ``hard``: its tag, role or style says that it isn't article. ``soft``: words of its class or id do."""

    __slots__ = ("begin", "end", "hard", "hash", "header", "own", "parent", "parts", "size", "soft", "tag")

    def __init__(self, tag: str, parent: int, begin: int, named: str = ""):
        self.tag, self.parent, self.begin, self.end = tag, parent, begin, begin
        self.hash, self.own, self.size, self.parts = 0, 0, 0, [f"{tag} {named}"]
        words = set(_WORDS.findall(named)) if named and tag not in HEADINGS else ()
        self.hard, self.soft = tag in NOT_TAGS, not NOT_WORDS.isdisjoint(words)
        self.header = tag == "header" or "header" in words


class Page:
    """A page as elements in page order and the text nodes between them; a break between blocks is a None."""

    def __init__(self, html: str):
        self.elements: list[Element] = [Element("", -1, 0)]
        self.texts: list[str | None] = []
        self._open, self._count = [0], Counter()
        at = 0
        while at < len(html):
            tag = _TAG.search(html, at)
            if tag is None:
                self._text(html[at:])
                break
            if tag.start() > at:
                self._text(html[at : tag.start()])
            at = tag.end()
            if tag[2] is None:
                continue
            name = tag[2].lower()
            if tag[1]:
                self._end(name)
                continue
            self._start(name, tag[3])
            if name in RAW and not tag[3].endswith("/"):
                # Raw text goes up to its end tag, or to the end of the page.
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                self._end(name)
        self._close(0)
        self.roots = self._roots()
        self.inside = self._inside()

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.texts.append(text)
        top = self.elements[self._open[-1]]
        words = " ".join(text.split())
        if words:
            top.own = (top.own + xxhash.xxh64_intdigest(words)) & MASK
            top.size += len(words)
            top.parts.append(words)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._pop(("p",), P_HOLDS)
            self._pop(("head",), frozenset())
            self.texts.append(None)
        if tag in CLOSES:
            self._pop(CLOSES[tag], HOLDS - set(CLOSES[tag]))
        if tag == "br":
            self.texts.append(" ")
        if tag in VOID:
            return
        has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        named = f"{has.get('class', '')} {has.get('id', '')}".lower().strip()
        e = Element(tag, self._open[-1], len(self.texts), named)
        e.hard = e.hard or has.get("role", "").lower() in NOT_ROLES or "hidden" in has or bool(_HIDDEN.search(has.get("style", "").lower()))
        if tag in ("html", "body"):
            e.hard = e.soft = False
        self.elements.append(e)
        self._open.append(len(self.elements) - 1)
        self._count[tag] += 1

    def _pop(self, tags: tuple[str, ...], holds: frozenset[str]) -> None:
        """Close open elements down to the outermost of ``tags`` that nothing of ``holds`` encloses."""
        if not any(self._count[t] for t in tags):
            return
        found = None
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.elements[self._open[depth]].tag
            if tag in tags:
                found = depth
            elif tag in holds:
                break
        if found is not None:
            self._close(found)

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.texts.append(None)
        if not self._count[tag]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            held = self.elements[self._open[depth]].tag
            if held == tag:
                self._close(depth)
                return
            if held in BLOCK and tag not in BLOCK:
                # The end of an inline element doesn't end a block within it.
                return

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            done = self.elements[self._open.pop()]
            self._count[done.tag] -= 1
            if done.tag in BLOCK:
                self.texts.append(None)
            done.end, done.hash = len(self.texts), xxhash.xxh64_intdigest("\0".join(done.parts))
            done.parts = []
            if self._open:
                above = self.elements[self._open[-1]]
                above.own, above.size = (above.own + done.own) & MASK, above.size + done.size
                above.parts.append(f"{done.hash:x}")

    def _roots(self) -> list[int]:
        """The outermost articles, else main elements, that aren't left out by name; else the page."""
        for tag in ("article", "main"):
            out, upto = [], 0
            for i, e in enumerate(self.elements):
                if e.tag == tag and e.begin >= upto and e.size and not self._left_out(i):
                    out.append(i)
                    upto = e.end
            if out:
                return out
        return [0]

    def _left_out(self, i: int) -> bool:
        """Whether it or an ancestor is left out by name; a class or id doesn't leave out what holds half of the page."""
        own = i
        while i > 0:
            e = self.elements[i]
            if e.hard or e.soft and (i == own or 2 * e.size <= self.elements[0].size):
                return True
            i = e.parent
        return False

    def _inside(self) -> list[bool]:
        """Which elements lie in a root, itself excluded."""
        out, marks = [False] * len(self.elements), set(self.roots)
        for i in range(1, len(out)):
            parent = self.elements[i].parent
            out[i] = out[parent] or parent in marks
        return out

    def candidates(self) -> Iterator[Element]:
        """Elements that may be template: blocks with text, at most half of the page's; of a marked article only what isn't running text."""
        marked, above = self.roots != [0], set()
        for r in self.roots:
            while r >= 0:
                above.add(r)
                r = self.elements[r].parent
        for i, e in enumerate(self.elements):
            if e.tag in BLOCK and e.size and i not in above and 2 * e.size <= self.elements[0].size and not (marked and self.inside[i] and e.tag in FLOW):
                yield e

    def _gone(self, templates: frozenset[int]) -> tuple[list[tuple[int, int]], int]:
        """Ranges of text nodes that go, and how many of them are templates."""
        gone: list[tuple[int, int]] = []
        upto = 0
        for e in self.candidates():
            if _signed(e.hash) in templates and e.begin >= upto:
                gone.append((e.begin, e.end))
                upto = e.end
        known = len(gone)
        for i, e in enumerate(self.elements):
            if not self.inside[i] or not (e.hard or e.soft and 10 * e.size < 9 * self.elements[0].size):
                continue
            if e.header and self.roots != [0]:
                # Of a header in the article its headings stay.
                within = takewhile(lambda h: h.begin < e.end, islice(self.elements, i, None))  # noqa: B023
                edges = [e.begin, *[x for h in within if h.tag in HEADINGS for x in (h.begin, h.end)], e.end]
                gone += zip(edges[::2], edges[1::2], strict=True)
            else:
                gone.append((e.begin, e.end))
        return gone, known

    def text(self, templates: frozenset[int]) -> tuple[str, int]:
        """The blocks of the article, and how many subtrees of the page are template, not counting those within others."""
        gone, known = self._gone(templates)
        keep = bytearray(len(self.texts))
        for r in self.roots:
            e = self.elements[r]
            keep[e.begin : e.end] = b"\1" * (e.end - e.begin)
        for a, b in gone:
            keep[a:b] = bytes(max(0, b - a))
        blocks, block = [], []
        for kept, text in zip(keep, self.texts, strict=True):
            if text is None:
                blocks.append("".join(block))
                block = []
            elif kept:
                block.append(text)
        blocks.append("".join(block))
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x), known


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) to (host, hash, rest) of the subtrees that may be template, once a page each; hash 0 stands for the page."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            hosts, hashes, rests = [], [], []
            part = batch.slice(i, 256)
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = Page(html)
                whole = page.elements[0].own
                seen = {0: whole} | {e.hash: (whole - e.own) & MASK for e in page.candidates()}
                hosts += [host] * len(seen)
                hashes += map(_signed, seen)
                rests += map(_signed, seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(rests, pa.int64())], names=["host", "hash", "rest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, html, templates) to (row, text, n_template)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            got = [Page(html).text(frozenset(known or ())) for html, known in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            columns = [part.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_template"])


def host_of(url: str = "url"):
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: int = LEAST_SHARE) -> DataFrame:
    """(host, templates: array of subtree hashes) of the hosts of ``pages(host, html)`` that have templates. A table.

    A hot host or subtree is counted in two aggregations, first by the rest of the page; a host's array is bounded by ``least_share``.
    """
    rows = pages.where("host != ''").mapInArrow(_subtrees, "host string, hash bigint, rest bigint").groupBy("host", "hash", "rest").agg(F.lit(1).alias("one"))
    counted = cut(rows.groupBy("host", "hash").agg(F.count("one").alias("n")).where((F.col("n") >= least_pages) | (F.col("hash") == 0)), "subtrees")
    whole = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    many = counted.where("hash != 0").join(whole, "host").where(F.col("n") * 100 >= F.col("pages") * least_share)
    return cut(many.groupBy("host").agg(F.collect_list("hash").alias("templates")), "templates")


def page_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: int = LEAST_SHARE, url: str = "url", html: str = "html") -> DataFrame:
    """Every row of ``pages`` without its html, with ``text``, ``n_chars`` and ``n_template`` (subtrees that its site repeats); they replace columns of these names.

    The text is that of the outermost ``article`` elements, else of ``main``, else of the page, without site templates
    and without elements whose tag, role, class or id says that they are something else. Character references are
    decoded, blocks joined by a line feed, white space (Unicode's) inside a block is one space. A null or empty page has
    an empty text. Pages without a host (null url) have no site, so nothing of them is template. Repeated rows are
    counted once as evidence and give a row each; an empty table gives none.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars", "n_template")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("row"), host_of(url).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    templates = site_templates(rows.select("host", "html"), least_pages, least_share)
    size = templates.agg(F.coalesce(F.sum(F.length("host") + 8 * F.size("templates") + 64), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left").select("row", "html", "templates")
    kind = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_template", T.LongType())])
    out = joined.mapInArrow(_texts, kind)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "text", F.length("text").cast("long").alias("n_chars"), "n_template")
