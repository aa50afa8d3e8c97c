"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is a sequence of tags and blocks of words. A word scores by what can be seen of its block on any page (the tag that holds
it, how long it is, how much of it is links, the names and kinds of the elements around it); a tag costs. Weights are log odds
counted on labelled pages, those that mark their article, with the tags ``article`` and ``main`` hidden, so that they hold for
pages without them; small counts set beforehand stand for what no labelled page has. One linear scan finds the run of blocks and
tags with the largest sum. Of its blocks, menus, asides, forms and what is named as an advert or a comment are left out; a form,
a dialog or an element with a name like "banner" that holds most of the page's words is a wrapper of the page and is none of these.

All steps take time in proportion to the page, whatever its nesting or how its tags are left open.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm.common import bounded, portions

MAX_LABELLED_PAGES = 2000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of a page, and those that HTML sets apart from the article.
_RAW = frozenset("script style textarea title".split())
_NO_TEXT = frozenset("script style textarea title noscript template iframe button select svg head object canvas".split())
_APART = frozenset("nav footer aside form dialog menu".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_HOLDS_HEADER = frozenset("article main section".split())
_ROOTS = frozenset("html body article main".split())
#: Names in a class or id that tell what an element is for, and words that go with them.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus cookie cookies consent notice popup modal overlay share sharing social "
    "related recommended recommendations subscribe newsletter signup signin login widget skip toolbar".split()
)
#: Those of them that, like forms and dialogs, may as well be around the whole page.
_WRAPS = frozenset("promo promotion banner masthead notice popup modal overlay share sharing social subscribe newsletter signup signin login widget skip toolbar sponsor sponsored".split())
_WRAP_TAGS = frozenset("form dialog".split())
_WRAP_ROLES = frozenset("dialog alertdialog banner".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Words, not in links, that a wrapper holds at least.
WRAPPED_WORDS = 50
_NEUTRAL = frozenset("site page list box bar wrap wrapper block area top bottom left right section container item items link links button buttons text inner outer main global the to and form".split())
#: Words that short lines of a page's frame hold.
_FRAME_WORDS = frozenset("copyright © (c) cookie cookies login log-in signin sign-in register subscribe".split())
_FRAME_PHRASES = ("all rights reserved", "sign in", "log in", "sign up", "privacy policy", "terms of")
_TAG = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in _RAW}
_NAME = re.compile(r"[a-z0-9]+")
#: Names around an element that are counted, the nearest ones; all of them score.
_COUNTED_NAMES = 8

#: Blocks (in an article, outside) that are counted beforehand for each feature; what is not listed starts at (0, 0).
PRIOR = {
    "in p": (30, 5), "in h1": (20, 5), "in h2": (20, 5), "in h3": (20, 6), "in blockquote": (10, 3), "in pre": (10, 3), "in li": (15, 12), "in td": (10, 10), "in div": (10, 10), "in root": (20, 5), "in header": (5, 20),
    "links none": (60, 15), "links some": (20, 10), "links most": (1, 30), "length 1": (6, 20), "length 4": (12, 20), "length 9": (15, 15), "length 19": (25, 8), "length more": (40, 3), "frame words": (1, 30), "apart": (0, 60),
}
PRIOR_BESIDE = (0, 20)
PRIOR_BLOCKS = (100, 100)


@dataclass
class Element:
    tag: str
    place: str  # the tag that holds text, where article, main and the page itself are one
    skip: bool = False  # its content is no text
    apart: bool = False  # it is set apart from the article
    article: bool = False
    holds_header: bool = False
    names: tuple[str, ...] = ()
    beside: float = 0.0  # what the names around it score
    up: Element | None = None
    wraps: bool = False  # what sets it apart does not if it holds most of the page
    header: bool = False  # it is set apart as a header unless it is that of a post
    own: tuple[tuple[bool, float], ...] = ()  # of its names: may it be that of a wrapper, and its score
    words: int = 0  # not in links, with all below
    headings: int = 0  # with all below
    paragraphs: int = 0  # directly below


@dataclass
class Block:
    """Words between two tags that are no inline ones, or such a tag (no words)."""

    element: Element
    tag: str = ""
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def features(self) -> list[str]:
        e, n = self.element, self.words
        out = ["apart"] if e.apart else []
        most = 2 * self.linked >= n
        out.append("in " + e.place + " of links" * most)
        out.append("links " + ("most" if most else "some" if self.linked else "none"))
        out.append("length " + next((str(k) for k in (1, 4, 9, 19) if n <= k), "more"))
        if n < 12:
            words = self.text().lower()
            if not _FRAME_WORDS.isdisjoint(words.split()) or any(p in words for p in _FRAME_PHRASES):
                out.append("frame words")
        return out


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and value else value))
    return out


def _names(attributes: dict[str, str]) -> list[str]:
    return list(dict.fromkeys(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()))


def _is_beside(name: str) -> bool:
    parts = _NAME.findall(name)
    return any(p in _BESIDE for p in parts) and all(p in _BESIDE or p in _NEUTRAL or p.isdigit() for p in parts)


def _may_wrap(name: str) -> bool:
    return _is_beside(name) and all(p in _WRAPS for p in _NAME.findall(name) if p in _BESIDE)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", its characters, ""), ("open", tag, attributes as written) and ("close", tag, ""); comments are left out."""
    at, n, simple = 0, len(html), False
    while at < n:
        start = html.find("<", at)
        if start < 0:
            yield "text", unescape(html[at:]), ""
            return
        if start > at:
            yield "text", unescape(html[at:start]), ""
        after = html[start + 1 : start + 2]
        if after == "/" or after in ("!", "?"):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            end = html.find(">", start)
            if end < 0:
                return
            found = re.match(r"[a-zA-Z][^\s/>]*", html[start + 2 : end]) if after == "/" else None
            if found:
                yield "close", found[0].lower(), ""
            at = end + 1
        elif after.isascii() and after.isalpha():
            found = None if simple else _TAG.match(html, start + 1)
            if found:
                tag, attributes, at = found[1].lower(), found[2], found.end()
            else:
                # A quote that is never closed: from here on tags end at the next angle bracket.
                simple = True
                end = html.find(">", start)
                if end < 0:
                    return
                name = re.match(r"[^\s/>]+", html[start + 1 : end])
                tag, attributes, at = name[0].lower(), html[start + 1 + name.end() : end], end + 1
            yield "open", tag, attributes
            if tag in _RAW and not attributes.endswith("/"):
                end = _RAW_END[tag].search(html, at)
                if end is None:
                    return
                at = end.start()
        else:
            yield "text", "<", ""
            at = start + 1


def parse(html: str, weigh: Callable[[str], float] = lambda name: 0.0) -> tuple[list[Block], bool]:
    """Blocks of words and tags in page order, and whether the page marks its article."""
    root = Element("", "root")
    stack, counts, elements = [root], Counter(), [root]
    out: list[Block] = []
    current: Block | None = None
    links = 0
    for kind, what, attributes in tokens(html):
        top = stack[-1]
        if kind == "text":
            if top.skip or not what:
                continue
            if current is None:
                if not what.strip():
                    continue
                current = Block(top)
                out.append(current)
            current.parts.append(what)
            n = len(what.split())
            current.words += n
            current.linked += n if links else 0
            continue
        if what == "br" and current is not None:
            current.parts.append(" ")
        if what not in _INLINE:
            current = None
        if kind == "open":
            if what not in _INLINE and top.tag == "p":
                counts["p"] -= 1
                stack.pop()
                top = stack[-1]
            if not top.skip:
                out.append(Block(top, what))
            if what in _VOID or attributes.endswith("/") and what not in _INLINE and what not in ("p", "div", "li"):
                continue
            own = _attributes(attributes) if "=" in attributes or "hidden" in attributes else {}
            names = [] if what in _ROOTS else _names(own)
            hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
            place = top.place if what in _INLINE or what in _ROOTS else what
            role, header = own.get("role", "").lower(), what == "header" and not top.holds_header
            top.paragraphs += what == "p"
            stack.append(
                Element(
                    what, place, top.skip or hidden or what in _NO_TEXT, what in _APART or role in _APART_ROLES or header, top.article or what in ("article", "main"), top.holds_header or what in _HOLDS_HEADER,
                    (*top.names, *names)[-_COUNTED_NAMES:] if names else top.names, up=top, wraps=what in _WRAP_TAGS and role not in _APART_ROLES - _WRAP_ROLES or what not in _APART and role in _WRAP_ROLES,
                    header=header and role not in _APART_ROLES, own=tuple((_may_wrap(x), weigh(x)) for x in names), headings=what in _HEADINGS,
                )
            )
            elements.append(stack[-1])
            counts[what] += 1
            links += what == "a"
        else:
            if not top.skip:
                out.append(Block(top, what))
            while counts[what] > 0:
                gone = stack.pop()
                counts[gone.tag] -= 1
                links -= gone.tag == "a"
                if gone.tag == what:
                    break
    return out, _set_apart(elements, out)


def _set_apart(elements: list[Element], blocks: list[Block]) -> bool:
    """Settle which elements (parents first) are set apart, now that all words are known; whether an article is marked."""
    for b in blocks:
        b.element.words += b.words - b.linked
    for e in reversed(elements[1:]):
        e.up.words += e.words
        e.up.headings += e.headings
    most, marked = max(elements[0].words / 2, WRAPPED_WORDS - 1), False
    for e in elements[1:]:
        holds = e.words > most
        post = e.header and e.headings and e.up.paragraphs and e.up.place != "root"
        marked |= e.tag in ("article", "main") and not e.up.apart
        e.apart = e.up.apart or e.apart and not (e.wraps and holds) and not post
        e.beside = min(max(e.up.beside + sum(x for wraps, x in e.own if not (wraps and holds)), -3.0), 3.0)
    return marked


class Weights:
    """Log odds of features, names and tags; counts are of blocks in an article and outside."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        seen = counts.get("blocks", (0, 0))
        inside, outside = seen[0] + PRIOR_BLOCKS[0], seen[1] + PRIOR_BLOCKS[1]
        self.base = math.log(inside / outside)
        self.counts, self.inside, self.outside = counts, inside, outside
        self._known: dict[str, float] = {}
        self._tags: dict[str, float] = {}

    def _odds(self, key: str, before: tuple[int, int]) -> float:
        i, o = self.counts.get(key, (0, 0))
        if not (i or o or before[0] or before[1]):
            return 0.0
        odds = math.log((i + before[0] + 0.5) / (self.inside + 1)) - math.log((o + before[1] + 0.5) / (self.outside + 1))
        return min(max(odds, -3.0), 3.0)

    def feature(self, key: str) -> float:
        if key not in self._known:
            self._known[key] = self._odds(key, PRIOR.get(key, (0, 0)))
        return self._known[key]

    def name(self, name: str) -> float:
        """A name of a class or id counts only if it speaks against an article."""
        return min(self._odds("name " + name, PRIOR_BESIDE if _is_beside(name) else (0, 0)), 0.0)

    def tag(self, tag: str) -> float:
        if tag not in self._tags:
            i, o = self.counts.get("tag " + tag, (0, 0))
            self._tags[tag] = -min(max(0.3 * math.log((o + 1) / (i + 1)), 0.05), 1.0)
        return self._tags[tag]

    def score(self, block: Block) -> float:
        """Of a tag its cost; of a block its words by what one is worth, between -1 and 1."""
        if block.tag:
            return self.tag(block.tag)
        if block.element.apart:
            return -0.5 * block.words
        odds = self.base + sum(map(self.feature, block.features()))
        if block.element.beside <= BESIDE:
            return -0.1 * block.words
        return min(max(odds + block.element.beside, -1.0), 1.0) * block.words


#: Names that score this or less set an element apart.
BESIDE = -1.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and end of the run with the largest positive sum; the earliest and shortest of equal ones, (0, 0) if none."""
    best = total = 0.0
    first = last = start = 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(html: str, weights: Weights) -> str:
    """The main text: blocks in page order, two line feeds between them; empty if there is none."""
    blocks, _ = parse(html, weights.name)
    first, last = best_run([weights.score(b) for b in blocks])
    kept = (b.text() for b in blocks[first:last] if not b.tag and not b.element.apart and b.element.beside > BESIDE)
    return "\n\n".join(t for t in kept if t)


def fit_weights(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_LABELLED_PAGES) -> Weights:
    """Weights from about ``max_pages`` labelled pages, taken by a hash of the page. Without labelled pages, those set before."""
    share = max(1, pages.count() // max_pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for _, texts in portions(batches, "html"):
            for t in texts:
                blocks, marked = parse(t)
                for b in blocks if marked else ():
                    to = inside if b.element.article and not b.element.apart else outside
                    if b.tag:
                        to["tag " + b.tag] += 1
                    elif b.words:
                        to.update(["blocks", *b.features(), *("name " + x for x in set(b.element.names))])
        keys = sorted({*inside, *outside})
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "inside": pa.array([inside[k] for k in keys], pa.int64()), "outside": pa.array([outside[k] for k in keys], pa.int64())})

    sample = pages.select(F.col(html_col).alias("html")).where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(share)) == 0))
    # One row for each kind of place and each name that the sample of pages has.
    rows = sample.mapInArrow(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return Weights({r["key"]: (r["i"], r["o"]) for r in rows})


def extract_text(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """Rows ``page_id, url, text, n_chars``: one for every page; a NULL or empty page has an empty text.

    Repeated rows each give their row, a NULL id or url stays NULL, other columns are ignored, whatever their names. Of pages
    that score alike in two places the first is taken.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "html"):
            found = [main_text(t, weights) for t in texts]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, fit_weights(pages))
