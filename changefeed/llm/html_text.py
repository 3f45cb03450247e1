"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not. A node's potential comes from its tag, the words of its
class, id and role, and its links and text; a parent-child potential from how often a child shares its parent's state. Messages
passed from the leaves to the root and back give each node's exact marginal; text of nodes that are likelier content than not is kept.

Potentials are counts over labelled pages: the examples below, where ``data-main`` gives the state of an element and what is in it, and a
bounded sample of the pages that mark their text as <article> or <main>.

A null or empty page has an empty text. Pages are independent: repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2_000  # pages that are learned from, of those that mark their text those with the smallest hash of their id
EXAMPLE_WEIGHT = 1000  # pages of the sample that one example counts as

# fixed values: elements by the role that the markup language gives them
BLOCKS = {
    *"html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption tr blockquote pre "
    "figure figcaption form fieldset details summary dialog address hr center menu search".split()
}
SPACED = {"br", "td", "th"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
VOID = {"hr"}

# dropped with what is in them: those that hold text only, up to the end of the page if not closed, and others, just the tag if not closed
RAW = {"script", "style", "textarea", "title", "iframe"}
DROPPED = {"template", "noscript", "select", "button", "object", "svg"}
NESTED = {"template", "object", "svg"}  # of these, those that can hold their like
_EDGE = re.compile(rf"<(/?)({'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
_START = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MAIN = re.compile(r"data-main=\"([01])\"")
_PART = re.compile(r"[a-z]+")


class Tags:
    """Where tags end. A page is passed over once: what was found to have no end is not looked through again."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.open_from: list[int] = []  # stretches outside quotes from which no end is reached
        self.open_to: list[int] = []

    def end(self, start: int) -> int:
        """The place after the first > from ``start`` on that is in no quotes; -1 without one."""
        at = bisect_right(self.open_from, start) - 1
        if at >= 0 and start <= self.open_to[at]:
            return -1
        passed, place = [], start
        while stop := _STOP.search(self.html, place):
            if stop[0] == ">":
                return stop.end()
            passed.append((place, stop.start()))
            place = self.html.find(stop[0], stop.end()) + 1 if stop.start() < self.last[stop[0]] else 0
            if not place:
                break
        else:
            passed.append((place, len(self.html)))
        for low, high in passed:
            at = bisect_right(self.open_from, low)
            self.open_from.insert(at, low)
            self.open_to.insert(at, high)
        return -1

    def plain_end(self, start: int) -> int:
        """The place after the next >, quotes or not; 0 without one."""
        return self.html.find(">", start) + 1 if start <= self.last[">"] else 0


class Token(NamedTuple):
    start: int
    end: int
    name: str  # empty for what is no element
    closing: bool
    given: str  # attributes


def next_token(tags: Tags, place: int) -> Token | None:
    """The first tag, comment, or element of RAW with what is in it, from ``place`` on; None if there is none."""
    html = tags.html
    while mark := _START.search(html, place):
        start, name = mark.start(), (mark[2] or "").lower()
        if mark[0] == "<!--":
            end = html.find("-->", mark.end())
            return Token(start, end + 3 if end >= 0 else len(html), "", False, "")
        if name:
            end = tags.end(mark.end())
            if name in RAW and not mark[1] and end >= 0 and html[mark.end() : mark.end() + 1] in (" ", "\t", "\n", "\r", "\f", "\v", "/", ">"):
                close = _RAW_END[name].search(html, end)
                return Token(start, close.end() if close else len(html), "", False, "")
            end = end if end >= 0 else tags.plain_end(mark.end())
            if end:
                return Token(start, end, name, bool(mark[1]), html[mark.end() : end - 1])
        elif end := tags.plain_end(mark.end()):
            return Token(start, end, "", False, "")
        # no tag ends from here on; a comment may begin
        place = html.find("<!--", start + 1)
        if place < 0:
            return None
    return None


def dropped(tags: Tags) -> dict[int, int]:
    """Where the start tag of each closed element of DROPPED ends: where its end tag ends. An svg that closes itself is empty."""
    open_tags: dict[str, list[int]] = {name: [] for name in DROPPED}
    ends = {}
    for edge in _EDGE.finditer(tags.html):
        name, end = edge[2].lower(), tags.end(edge.end())
        if end < 0:
            continue
        if edge[1]:
            if open_tags[name]:
                ends[open_tags[name].pop()] = end
        elif name != "svg" or not tags.html[edge.end() : end - 1].endswith("/"):
            if name not in NESTED:
                open_tags[name].clear()
            open_tags[name].append(end)
    return ends


class Page:
    """Nodes of a page (parent before child) and its stretches of text in page order, each with its node."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names, self.main = [-1], ["#page"], [()], [None]
        self.text, self.linked = [0], [0]
        self.stretches: list[tuple[int, str]] = []
        self._build(html)

    def _build(self, html: str) -> None:
        stack, node, links, run, at = [0], 0, 0, [], 0
        ends: dict[int, int] | None = None

        def flush() -> None:
            if run:
                whole = " ".join(unescape("".join(run)).split())
                if whole:
                    self.stretches.append((stack[-1], whole))
                run.clear()

        def add(part: str) -> None:
            if part:
                run.append(part)
                size = len(part.strip())
                self.text[stack[-1]] += size
                self.linked[stack[-1]] += size * (links > 0)

        tags, open_now = Tags(html), Counter()
        while token := next_token(tags, at):
            add(html[at : token.start])
            at, name, closing = token.end, token.name, token.closing
            if name in DROPPED:
                if not closing:
                    ends = dropped(tags) if ends is None else ends
                    at = ends.get(at, at)
            elif name == "a":
                links = 0 if closing else 1
            elif name in SPACED:
                run.append(" ")
            elif name in BLOCKS:
                flush()
                if closing:
                    while open_now[name]:
                        gone = self.tag[stack.pop()]
                        open_now[gone] -= 1
                        if gone == name:
                            break
                    continue
                if self.tag[stack[-1]] == "p":
                    open_now[self.tag[stack.pop()]] -= 1
                if name in CLOSES and self.tag[stack[-1]] in CLOSES[name]:
                    open_now[self.tag[stack.pop()]] -= 1
                node = len(self.tag)
                given = token.given
                words = " ".join("".join(m) for m in _NAMES.findall(given)).lower() if given else ""
                main = _MAIN.search(given)
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.names.append(tuple(sorted({*_PART.findall(words)})) if words else ())
                self.main.append(int(main[1]) if main else None)
                self.text.append(0)
                self.linked.append(0)
                if name not in VOID:
                    stack.append(node)
                    open_now[name] += 1
        add(html[at:])
        flush()

    def features(self, i: int) -> list[str]:
        """What a node's potential depends on."""
        size = self.text[i]
        links = "none" if not self.linked[i] else "some" if self.linked[i] * 2 < size else "most"
        return [f"tag {self.tag[i]}", *(f"name {n}" for n in self.names[i]), f"links {links}", f"size {min(size, 1000).bit_length() // 3}"]

    def states(self) -> list[int]:
        """Labels of the nodes where an element says so, else those of the parent; content under <article> or <main> if none says so."""
        marked = any(m is not None for m in self.main)
        out = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            if marked:
                out[i] = out[self.parent[i]] if self.main[i] is None else self.main[i]
            else:
                outside = self.tag[i] in ("nav", "aside", "footer", "header", "form") or "ad" in self.names[i]
                out[i] = int(not outside and (out[self.parent[i]] or self.tag[i] in ("article", "main")))
        return out


def counts(page: Page) -> Counter:
    """(what, state of the parent or '', own state): how often, over the nodes of a labelled page."""
    states, found = page.states(), Counter()
    for i in range(1, len(states)):
        for feature in page.features(i):
            found[feature, "", states[i]] += 1
        found["child", states[page.parent[i]], states[i]] += 1
        found["node", "", states[i]] += 1
    return found


class Potentials:
    """Log-odds of features, and the parent-child table, from counts."""

    def __init__(self, found: Counter, smooth: float = 0.2):
        nodes = [found["node", "", s] + smooth for s in (0, 1)]
        names = {f for f, of, _ in found if of == "" and f != "node"}
        self.odds = {
            f: math.log((found[f, "", 1] + smooth) / (nodes[1] + smooth)) - math.log((found[f, "", 0] + smooth) / (nodes[0] + smooth))
            for f in names
        }
        child = [[found["child", p, s] + smooth for s in (0, 1)] for p in (0, 1)]
        self.child = [[child[p][s] / sum(child[p]) for s in (0, 1)] for p in (0, 1)]

    def node(self, features: list[str]) -> float:
        """Odds of content by the node alone."""
        return math.exp(max(-25.0, min(25.0, sum(self.odds.get(f, 0.0) for f in features))))

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node: messages as odds, first from the leaves up, then from the root down."""
        (same0, up0), (down1, same1) = self.child
        n = len(page.tag)
        own = [self.node(page.features(i)) for i in range(n)]
        own[0] = 1e-9  # the page itself
        message = [1.0] * n
        for i in range(n - 1, 0, -1):
            message[i] = (down1 + same1 * own[i]) / (same0 + up0 * own[i])
            j = page.parent[i]
            own[j] = min(1e100, max(1e-100, own[j] * message[i]))
        for i in range(1, n):
            rest = own[page.parent[i]] / message[i]
            own[i] = min(1e100, max(1e-100, own[i] * (up0 + same1 * rest) / (same0 + down1 * rest)))
        return [o / (1 + o) for o in own]

    def text(self, html: str) -> str:
        page = Page(html)
        content = self.marginals(page)
        return "\n\n".join(text for node, text in page.stretches if content[node] >= 0.5)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Potentials:
    """Potentials from the examples and a bounded sample of ``pages`` (page_id, html)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: Counter = Counter()
            for html in frame["html"]:
                page = Page(html or "")
                if {"article", "main"} & {*page.tag}:
                    found.update(counts(page))
            yield pd.DataFrame([(f, str(of), s, c) for (f, of, s), c in found.items()], columns=["what", "parent", "state", "n"])

    marked = F.col("html").rlike(r"(?i)<(article|main)[\s/>]")
    ids = pages.where(F.col("page_id").isNotNull() & marked).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    # at most sample_pages numbers; all counts of the sample, as a feature without one of its states would have wrong odds
    rows = (
        pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")
        .mapInPandas(count, "what string, parent string, state int, n bigint")
        .groupBy("what", "parent", "state").agg(F.sum("n").alias("n"))
        .collect()
    )
    total = Counter({(r.what, int(r.parent) if r.parent else "", r.state): r.n for r in rows})
    for example in EXAMPLES:
        total.update({k: n * EXAMPLE_WEIGHT for k, n in counts(Page(example)).items()})
    return Potentials(total)


def main_text(pages: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    potentials = potentials or train(pages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [potentials.text(html or "") for html in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [*map(len, texts)]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")


_WORDS = "The river rose in the night and by morning the lower road was under water, so the carts went round by the hill."
_LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Archive", "About"))

EXAMPLES = (
    f"""<html><body><header data-main="0"><div class="logo">Daily</div><nav class="menu"><ul>{_LINKS}</ul></nav></header>
    <div id="content"><article class="post" data-main="1"><h1>High water</h1><p>{_WORDS}</p><h2>After</h2><p>Short.</p><blockquote>{_WORDS}</blockquote>
    <ul><li>One point of the story</li><li>Another point</li></ul><div class="ad advert" data-main="0"><p>Buy now, only today</p></div><p>{_WORDS}</p></article></div>
    <aside class="sidebar related" data-main="0"><h3>More</h3><ul>{_LINKS}</ul><p>Read more of this</p></aside>
    <section class="comments" id="comments" data-main="0"><h2>Comments</h2><div class="comment"><p>{_WORDS}</p></div></section>
    <footer data-main="0"><p>All rights reserved</p><ul>{_LINKS}</ul></footer></body></html>""",
    f"""<html><body><div class="cookie notice banner" role="dialog" data-main="0"><p>We use cookies. Accept?</p></div><div class="nav navigation" data-main="0">{_LINKS}</div>
    <main role="main"><div class="content entry" data-main="1"><h1>A road reopened</h1><p>{_WORDS}</p><p>Yes.</p><table><tr><td>day</td><td>level</td></tr></table>
    <pre>one two</pre><figure><figcaption>The hill</figcaption></figure></div><form class="search newsletter subscribe" data-main="0"><p>Your address</p></form></main>
    <div class="share social" data-main="0"><p>Share this</p></div><div class="footer" id="footer" data-main="0">Imprint</div></body></html>""",
    f"""<html><body><div id="header" data-main="0"><h2>Site</h2></div><div id="main"><div class="story text body" data-main="1"><h1>Letters</h1><p>{_WORDS}</p><p>{_WORDS}</p>
    <ol><li>first</li><li>second</li></ol></div><div class="ads sponsored promo" data-main="0"><div>Offer</div></div><div class="widget sidebar" data-main="0"><div>{_LINKS}</div></div>
    <div class="reply respond comment" data-main="0"><p>{_WORDS}</p><p>I agree</p></div></div><div class="breadcrumb" data-main="0"><a href="/">Home</a></div></body></html>""",
    f"""<html><body><nav data-main="0"><ul>{_LINKS}</ul></nav><div class="ad" data-main="0">{_WORDS}</div><article data-main="1"><h1>Short</h1><p>{_WORDS}</p><p>It ended.</p></article>
    <footer data-main="0">&copy; somebody</footer></body></html>""",
    f"""<html><body><article data-main="1"><header><h1>Kept title</h1></header><section><h2>Part</h2><p>{_WORDS}</p><dl><dt>Term</dt><dd>Meaning</dd></dl></section>
    <footer data-main="0"><p>Tags</p></footer></article><aside data-main="0"><p>{_WORDS}</p></aside></body></html>""",
)
