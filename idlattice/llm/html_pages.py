"""Main text of web pages with a site style tree.

Pages of one host are merged element by element: an element's place is its path of tags and classes, where digits
don't count; ids, which pages make up as they go, are no part of it. A text stands at the place of the element that it begins in. From the merged tree comes the
importance of every place that holds text (after Yi, Liu and Li, "Eliminating noisy information in web pages for
data mining", 2003):

* presentation: the entropy of the place's styles (sequences of child elements) over the host's pages;
* content: the mean over its texts of 1 - log(pages with the text) / log(pages of the host);
* the larger of both counts, relative to the same measure over all places of the host, so that a host of
  copies of one page has nothing unimportant.

A host's estimate is blended with one over all hosts, which weighs as much as ``BLEND`` pages, and that one with what
tags and names alone suggest, the square of the place's prior. So a host of a single page is judged by what its places are
elsewhere, and by tags and names where nothing else is known; one of many pages by itself; no host is left out and none
switches from one rule to another.

The least prior along the path also multiplies the importance: elements that are furniture by tag, by a hidden style or by a class,
id or role whose head is such a word (``ROLES``) bear ``FURNITURE``, which is below ``LOWEST``: menus, comments and adverts differ from
page to page as stories do, so entropy can't save them. All other priors are above it: a place whose texts differ from page to page
stays, and one that repeats falls the sooner, the more its name speaks against it. A name that merely holds such a word bears ``HINT``;
inside an ``article`` or ``main`` only the names of ``CERTAIN``, standing alone, say more, and bear ``INNER``. On a page with an article or
main, what stands outside bears ``OUTSIDE``. A heading inside an article bears ``HEADING``: it may be the same
on every page and still tells what follows. Texts at places whose importance is below ``LOWEST`` go; all others stay.

The tree is held as counts: rows (host, place, style or text), summed by aggregation, so that a host with a
third of all pages is no group of its own anywhere. A host's list of places to remove is joined to its pages; it
holds places of templates, not of pages, as ids and digits don't count in them.

Defined cases: null or empty html has no text; a null or hostless url counts as host ""; broken markup is read as
browsers do in the main: unclosed p and li end at the next, stray end tags are ignored, a tag that the page ends in is
none; repeated rows count as pages of their own. Reading takes time in proportion to the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, read, slices

LOWEST = 0.2
BLEND = 2
#: Priors of furniture, of names of furniture in an article, of what stands outside one, and of names that hold a word of furniture.
FURNITURE, INNER, OUTSIDE, HINT = 0.1, 0.3, 0.6, 0.6
#: Prior of headings inside an article; with FLOOR it lifts even one that all pages share over LOWEST.
HEADING = 5.0
#: Importance is compared above this, so that a host of copies compares alike with alike.
FLOOR = 0.05

#: Elements by kind.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map", "fieldset", "datalist"}
BOUNDS = ("article", "main")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
BARRIERS = ("ul", "ol", "dl", "table", "article", "section", "div", "main")
#: Names in class, id or role that stand for furniture.
ROLES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "sidebar", "sidebars", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "logo", "branding", "side", "footer", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "login", "signin", "signup", "register", "search", "toolbar", "pagination", "pager", "hidden", "contentinfo", "complementary", "alert", "copyright", "form", "tags", "tagcloud", "skip"}
#: Those that leave no doubt inside an article either.
CERTAIN = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adslot", "sponsored", "cookies", "consent", "gdpr", "popup", "newsletter", "sidebar", "navbar", "navigation", "breadcrumbs", "comments", "disqus", "respond", "replies", "sharing", "login", "signup", "pagination", "contentinfo", "complementary", "menu", "nav", "footer", "share", "widget"}
#: First words of a name that say whether its page has such furniture.
MERELY_HAVE = {"with", "has", "no", "is", "without"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# Quotes have a meaning only where a value begins.
_TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_CAPITAL = re.compile(r"([a-z])([A-Z])")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def prior_of(tag: str, own: dict[str, str], inside: bool) -> float:
    """How much an element's tag and attributes let its text count, before any page is compared; inside: of an article or main."""
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return FURNITURE
    if not own or tag in ("html", "body", *BOUNDS):
        return 1.0
    if "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN_STYLE.search(own.get("style", "")):
        return FURNITURE
    found = 1.0
    for name in f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".split():
        words = _WORD.findall(_CAPITAL.sub(r"\1 \2", name).lower())
        if not any(word in ROLES for word in words):
            continue
        if inside:
            certain = len(words) == 1 and name.isalpha() and words[0] in CERTAIN
        else:
            certain = words[-1] in ROLES and words[0] not in MERELY_HAVE
        found = min(found, (INNER if inside else FURNITURE) if certain else HINT)
    return found


class Node:
    __slots__ = ("tag", "place", "prior", "inside", "children")

    def __init__(self, tag: str, place: int, prior: float, inside: bool) -> None:
        self.tag, self.place, self.prior, self.inside = tag, place, prior, inside
        self.children: list[str] = []


class Page:
    """A page read once, from the first sign to the last.

    blocks: for every block of text its parts (element that the part begins in, raw text). A block has more than one
    part only where an inline element of another prior stands in it. nodes: all elements that hold text.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[list[tuple[Node, str]]] = []
        self.bounded = False
        self.quotes = True  # until one hides all that follows
        self.stack = [Node("", 0, 1.0, False)]
        self.open: dict[str, list[int]] = {}
        self.parts: list[tuple[Node, list[str]]] = []
        self.read(page)
        self.flush()

    def flush(self) -> None:
        if self.parts:
            self.blocks.append([(node, "".join(raw)) for node, raw in self.parts])
            self.parts = []

    def text(self, raw: str) -> None:
        if not raw:
            return
        top = self.stack[-1]
        if self.parts and self.parts[-1][0].prior == top.prior:
            self.parts[-1][1].append(entities.unescape(raw) if "&" in raw else raw)
        else:
            self.parts.append((top, [entities.unescape(raw) if "&" in raw else raw]))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of that tag, 0 where there is none."""
        found = self.open.get(tag)
        return found[-1] if found else 0

    def read(self, page: str) -> None:
        at = 0
        while True:
            start = page.find("<", at)
            if start < 0:
                self.text(page[at:])
                return
            follows = page[start + 1 : start + 2]
            if follows in ("!", "?"):
                self.text(page[at:start])
                at = self.declaration(page, start)
                continue
            name = _NAME.match(page, start + 1 + (follows == "/"))
            if name is None:  # a sign of its own; "</" before anything else is a remark up to the next ">"
                self.text(page[at : start + (follows != "/")])
                end = page.find(">", start) if follows == "/" else start
                at = (end + 1) if end >= 0 else len(page)
                continue
            rest = _TAG_REST.match(page, name.end()) if self.quotes else None
            self.quotes = rest is not None
            end = rest.end() if rest else page.find(">", name.end()) + 1
            self.text(page[at:start])
            if not end:
                return
            tag = name[0].lower()
            if follows == "/":
                self.end(tag)
                at = end
            else:
                at = self.begin(tag, page, name.end(), end)

    def declaration(self, page: str, start: int) -> int:
        """Pass a comment, CDATA section or declaration; the place behind it."""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            return end + 3 if end >= 0 else len(page)
        if page.startswith("<![CDATA[", start) and (end := page.find("]]>", start)) >= 0:
            self.text(page[start + 9 : end].replace("&", "&amp;"))
            return end + 3
        end = page.find(">", start)
        return end + 1 if end >= 0 else len(page)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        depth = self.last(tag)
        if depth and tag not in ("html", "body"):
            self.close_to(depth)

    def begin(self, tag: str, page: str, attributes: int, end: int) -> int:
        """Open an element; the place behind its tag, or behind its end if its content is no text."""
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.text(" ")
            return end
        if tag in VOID:
            return end
        if tag in RAW:
            close = _ENDS[tag].search(page, end)
            return (page.find(">", close.end()) + 1 if close else 0) or len(page)
        if tag not in INLINE:
            depth = max(self.last("p"), self.last(tag) if tag in CLOSED_BY_SAME else 0)
            if depth > max(map(self.last, BARRIERS)):
                self.close_to(depth)
        top = self.stack[-1]
        own = _attributes(page[attributes : end - 1])
        inside = top.inside or tag in BOUNDS or own.get("role") == "main"
        prior = prior_of(tag, own, inside)
        if prior == 1.0 and inside and (tag in HEADINGS or top.prior == HEADING):
            prior = HEADING
        prior = prior if top.prior == 1.0 else min(top.prior, prior)
        self.bounded = self.bounded or (inside and not top.inside and prior > FURNITURE)
        style = _DIGITS.sub("", f"{tag}.{own['class']}") if own.get("class") else tag
        top.children.append(style)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(tag, xxhash.xxh64_intdigest(f"{top.place}>{style}>{prior}"), prior, inside))
        return end

    def place(self, node: Node) -> tuple[int, float]:
        """(place, prior) of a text: outside the article of a page that has one, both are others."""
        if self.bounded and not node.inside:
            return xxhash.xxh64_intdigest(f"{node.place}<"), min(node.prior, OUTSIDE)
        return node.place, node.prior


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def page_tree(page: str) -> list[tuple[int, float, int, int]]:
    """The page's share of the style tree: (place, prior, kind, value), each once; kind 0 a style, 1 a text."""
    read = Page(page)
    rows: set[tuple[int, float, int, int]] = set()
    for block in read.blocks:
        for node, raw in block:
            if text := _clean(raw):
                place, prior = read.place(node)
                rows.add((place, prior, 1, xxhash.xxh64_intdigest(text)))
                rows.add((place, prior, 0, xxhash.xxh64_intdigest("|".join(node.children))))
    return [(_signed(a), b, c, _signed(d)) for a, b, c, d in rows]


def alone(prior: float) -> float:
    """Importance of a place of which no page is known but its own."""
    return prior * (min(1.0, prior**2) + FLOOR) / (1 + FLOOR)


def main_text(page: str, low: set[int] | None = None) -> str:
    """Blocks of the page without the texts at ``low`` places; by default those that are low in the tree of this page alone."""
    read = Page(page)
    if low is None:
        low = {_signed(place) for place, prior in (read.place(node) for block in read.blocks for node, _ in block) if alone(prior) < LOWEST}
    kept = (_clean("".join(raw for node, raw in block if _signed(read.place(node)[0]) not in low)) for block in read.blocks)
    return "\n\n".join(filter(None, kept))


def importance_of(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, place, prior, importance. shares: (host, place, prior, kind, value, k pages); sizes: (host, m pages)."""
    style, content, k = F.col("kind") == 0, F.col("kind") == 1, F.col("k").cast("double")

    def measured(by: list[str], *more) -> DataFrame:
        """Sums from which the entropies of a place, or of all places of a host, follow."""
        return shares.groupBy(*by).agg(F.sum(F.when(style, k)).alias("seen"), F.sum(F.when(style, k * F.log(k))).alias("klogk"), F.sum(F.when(content, F.log(k))).alias("spread"), F.count_if(content).alias("texts"), *more)

    log_m = F.log(F.greatest("m", F.lit(2)))
    presentation = F.greatest(F.lit(0.0), (F.log("seen") - F.col("klogk") / F.col("seen")) / log_m)
    own = F.greatest(presentation, 1 - F.col("spread") / F.col("texts") / log_m)
    evidence = (F.col("m") - 1).cast("double")
    places = measured(["host", "place"], F.min("prior").alias("prior")).join(sizes, "host").select("host", "place", "prior", "m", own.alias("own"), evidence.alias("n"))
    blended = lambda near, n, far: (F.col(near) * F.col(n) + far * BLEND) / (F.col(n) + BLEND)
    pooled = places.groupBy("place").agg((F.sum(F.col("own") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1.0))).alias("own"), F.sum("n").alias("n"), F.least(F.lit(1.0), F.min("prior") * F.min("prior")).alias("named")).select("place", blended("own", "n", F.col("named")).alias("elsewhere"))
    # the whole host: the mean of what all its distinct texts are worth
    hosts = shares.where(content).groupBy("host").agg(F.avg(F.log(k)).alias("spread")).join(sizes, "host").select("host", (1 - F.col("spread") / log_m).alias("whole"), evidence.alias("n"))
    worth, n = hosts.agg(F.sum(F.col("whole") * F.col("n")), F.sum("n")).first()
    average = ((worth or 0.0) + BLEND) / ((n or 0.0) + BLEND)
    roots = hosts.select("host", blended("whole", "n", F.lit(average)).alias("root"))
    met = places.join(pooled, "place").join(roots, "host")
    relative = (blended("own", "n", F.col("elsewhere")) + FLOOR) / (F.col("root") + FLOOR)
    return met.select("host", "place", "prior", (F.least(F.lit(1.0), relative) * F.col("prior")).alias("importance"))


def low_places(pages: DataFrame, html: str = "html", url: str = "url", lowest: float = LOWEST) -> DataFrame:
    """host, low: the places of each host whose importance falls below ``lowest``."""
    source = pages.select(host_of(url).alias("host"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            trees = [page_tree(x.decode()) for x in raw]
            at = np.repeat(np.arange(len(raw)), [len(x) for x in trees])
            place, prior, kind, value = zip(*[row for x in trees for row in x], strict=True) if len(at) else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(place, pa.int64()), pa.array(prior, pa.float64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], names=["host", "place", "prior", "kind", "value"])

    rows = source.mapInArrow(run, "host string, place long, prior double, kind int, value long")
    shares = materialize(rows.groupBy("host", "place", "kind", "value").agg(F.count(F.lit(1)).alias("k"), F.min("prior").alias("prior")), "style-tree")
    sizes = pages.select(host_of(url).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    low = importance_of(shares, sizes).where(F.col("importance") < lowest)
    return materialize(low.groupBy("host").agg(F.collect_list("place").alias("low")), "low-places")


def host_of(url: str):
    """Host of the url in lower case, without port; "" where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages (or its ``keep`` columns) with text and n_chars, which replace columns of these names."""
    names = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    host, low, raw_html = (fresh(pages, name) for name in ("__host", "__low", "__html"))
    found = low_places(pages, html, url).select(F.col("host").alias(host), F.col("low").alias(low))
    source = pages.select(*[F.col(f"`{c}`") for c in names], host_of(url).alias(host), F.col(f"`{html}`").alias(raw_html))
    joined = source.join(found, host, "left").select(*[f"`{c}`" for c in names], low, raw_html)
    schema = joined.select(*[f"`{c}`" for c in names]).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, raw_html):
            lists = batch.column(at).to_pylist()
            made = [main_text(x.decode(), set(gone or ())) for x, gone in zip(raw, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())], names=[*names, "text", "n_chars"])

    return joined.mapInArrow(run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
