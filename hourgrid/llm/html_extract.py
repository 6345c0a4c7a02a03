"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Scripts, styles, forms, menus, headers,
footers, sidebars, adverts, notices and reader comments go by their elements, roles and
class names.  Then two passes over what is left:

1. each block is classed by its link density, its length and its density of stop words, in an
   article (or main) element and outside: good, bad, or ambiguous where it is too short to
   tell.  The element is a prior for two kinds only, if one article has at least as much prose
   as all that is outside: prose of moderate length outside is ambiguous, and blocks without
   enough stop words are good in an article that has no prose by them (another language).
   Where an article has prose, such blocks are bad if long and ambiguous if of moderate length;
2. an ambiguous block inherits the label of the nearest decided block of its part of the page
   (its article, or the page): the one of both sides, else that of the nearer side, the one
   before on a tie.  Where nothing is decided, ambiguous blocks of an article are good by that
   prior, others bad.

Null and empty pages have empty text.  Markup that is never closed ends with the page.
Repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hourgrid.llm.common import bounded_batches, fresh

# Names of elements, roles and classes.
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLES = {"article", "main"}
DROPPED = {"head", "nav", "menu", "header", "footer", "aside", "form", "button", "select", "input", "label", "fieldset", "dialog", "svg", "math", "canvas", "audio", "video", "object", "map"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form", "article-comments"}
DROPPED_CLASSES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist respond disqus share sharing social related recommended newsletter subscribe signup login popup modal overlay widget pagination pager toolbar skip".split()
)
CONTENT_CLASSES = set("content article post entry main body text story page wrapper container".split())
COMMENTS = {"comment", "comments", "commentlist", "respond", "disqus"}
#: Elements that end an open element of the same set.
SIBLINGS = [{"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}]

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = set(
    """the of and to in is was that it for on as with by at from this be are or an have not they which but his her their has had were been if when there can will would what so
    le la les de des du un une et est en que qui dans pour pas sur au aux avec ce il elle sont par plus ne se ou mais son sa ses
    der die das und ist von den dem zu mit sich des ein eine im nicht auf für als auch es an werden aus er hat dass sie nach bei wird
    el los las y del que una por con no para su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre""".split()
)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?[a-zA-Z][^>]*>?|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[^\W\d_]+")

LINK_DENSITY = 0.5
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_DENSITY = 0.1


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: int  # number of the article it is in, 0 outside
    heading: bool


@dataclass
class _Open:
    name: str
    dropped: bool
    comments: bool
    article: int
    heading: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    articles: int = 0

    def end_block(self, at: _Open) -> None:
        text = " ".join(entities.unescape("".join(self.parts)).split())
        if text and not at.dropped:
            self.blocks.append(Block(text, self.linked, at.article, at.heading))
        self.parts.clear()
        self.linked = 0


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}


def _opened(name: str, attrs: str, inside: _Open, page: _Page) -> _Open:
    a = _attributes(attrs) if attrs.strip() else {}
    words = set(re.findall(r"[a-z]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
    comments = inside.comments or bool(words & COMMENTS)
    article = inside.article
    if name in ARTICLES and not comments:
        # an article is content even where a menu before it was never closed
        if not article:
            page.articles += 1
            article = page.articles
        return _Open(name, False, False, article)
    by_class = bool(words & DROPPED_CLASSES) and not words & CONTENT_CLASSES and name not in ("html", "body")
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs)) or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    if article and name == "header" and not by_class:
        # of the header of an article its headings are content
        return _Open(name, True, comments, article)
    heading = name in HEADINGS
    kept_heading = heading and inside.name == "header" and bool(article) and not comments
    dropped = (inside.dropped and not kept_heading) or comments or name in DROPPED or by_class or hidden or a.get("role", "").lower() in DROPPED_ROLES
    return _Open(name, dropped, comments, article, inside.heading or heading)


def blocks_of(page_html: str) -> list[Block]:
    """The blocks of a page without what goes by its element, role or class."""
    page, stack = _Page(), [_Open("", False, False, 0)]
    # how many elements of a name are open: a closing tag that has none is passed over without a search
    open_names: Counter[str] = Counter()
    links, at, end = 0, 0, len(page_html)
    while at < end:
        m = TOKEN.match(page_html, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        if (t := m["text"]) is not None:
            page.parts.append(t)
            if links:
                page.linked += len(t.strip())
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            page.end_block(stack[-1])
        if m["close"]:
            while open_names[name]:
                gone = stack.pop()
                open_names[gone.name] -= 1
                links -= gone.name == "a"
                if gone.name == name:
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page_html, at)
            at = close.end() if close else end
            continue
        if m["attrs"].endswith("/") and name in DROPPED:
            continue
        for same in SIBLINGS:
            if name in same and stack[-1].name in same:
                open_names[stack.pop().name] -= 1
        if name == "p" and stack[-1].name == "p":
            open_names[stack.pop().name] -= 1
        if name == "a":
            links += 1
        open_names[name] += 1
        stack.append(_opened(name, m["attrs"], stack[-1], page))
    page.end_block(stack[-1])
    return page.blocks


def _dense(b: Block) -> bool:
    words = WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * max(len(words), 1)


def first_pass(blocks: list[Block]) -> tuple[list[bool | None], bool]:
    """By block True: good, False: bad, None: ambiguous; and whether the articles hold the page's prose."""
    open_ = [b.linked <= LINK_DENSITY * len(b.text) and len(b.text) >= SHORT_CHARS for b in blocks]
    dense = [o and _dense(b) for b, o in zip(blocks, open_, strict=True)]
    prose: dict[int, int] = {}
    for b, d in zip(blocks, dense, strict=True):
        prose[b.article] = prose.get(b.article, 0) + d * len(b.text)
    most = max((n for article, n in prose.items() if article), default=-1)
    inside = most >= prose.get(0, 0)
    out: list[bool | None] = []
    for b, o, d in zip(blocks, open_, dense, strict=True):
        if b.linked > LINK_DENSITY * len(b.text):
            out.append(False)
        elif not o:
            out.append(None)
        elif d:
            # prose beside an article that holds more of it may be a notice
            out.append(None if inside and not b.article and len(b.text) < LONG_CHARS else True)
        elif inside and b.article and not prose[b.article]:
            # an article without any prose is in a language that the stop words do not tell
            out.append(True)
        else:
            # of an article, a block of moderate length has too few words to go by them alone
            out.append(None if b.article and len(b.text) < LONG_CHARS else False)
    return out, inside


def labels(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    first, inside = first_pass(blocks)
    before: list[tuple[int, bool] | None] = [None] * len(blocks)
    after: list[tuple[int, bool] | None] = [None] * len(blocks)
    for order, held in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if (label := first[i]) is not None:
                last[blocks[i].article] = (i, label)
            held[i] = last.get(blocks[i].article)
    out = []
    for i, b in enumerate(blocks):
        if (label := first[i]) is not None:
            out.append(label)
        elif before[i] is None and after[i] is None:
            out.append(inside and b.article > 0)
        else:
            sides = sorted((abs(s[0] - i), n, s[1]) for n, s in enumerate((before[i], after[i])) if s)
            out.append(sides[0][2])
    return out


def main_text(page_html: str | None) -> str:
    if not page_html:
        return ""
    blocks = blocks_of(page_html)
    return " ".join(b.text for b, good in zip(blocks, labels(blocks), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (underscores in front if taken) in place of the html column."""
    bounded_batches(pages.sparkSession)
    at, rest = pages.columns.index(html), [f for f in pages.schema.fields if f.name != html]
    name = fresh(pages.drop(html), "text")
    schema = T.StructType([*rest, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], texts], names=schema.names)

    return pages.mapInArrow(run, schema)


__all__ = ["blocks_of", "extract", "labels", "main_text"]
