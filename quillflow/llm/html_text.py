"""Operator 9: main text of web pages.

The standard library's parser streams its events; blocks (what stands between two
block-level tags) are the lines of the text-to-tag ratio.  Elements whose kind,
role, class or id says that they are not the article are skipped with what they
hold.  Ratios are smoothed by a Gaussian and split in two clusters by a threshold;
the content region is the article or main element with most text of the upper
cluster, or without one the smallest element that holds nearly all of it.  All
blocks of the region are kept, short ones too, except lists of links.

Defined cases: a null page is empty; an empty page, or one without text, gives the
empty text; unclosed and misnested tags end with the element around them; very
long pages are parsed whole; repeated pages give repeated results; other columns
play no part.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br".split())
SKIPPED = frozenset("script style noscript template head title nav aside footer form button select textarea input iframe object svg canvas dialog menu audio video map".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class names and ids of block elements that mark what is not the article; as a part of a longer name they only make the element doubtful.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond replies disqus related recommended recommendations widget pagination pager".split()
)
AUTO_CLOSE = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
SIGMA, RADIUS, MOST = 1.0, 2, 0.9


class _Blocks(HTMLParser):
    """Collects blocks: (words, tags, characters in links, element that holds it, outermost doubtful element around it or 0); elements: their parent and whether they are an article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, int]] = []
        self.parents, self.article = [-1], [False]
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, element that was current before, whether it is skipped, doubtful element before
        self.open: dict[str, int] = {}
        self.current, self.skip, self.links, self.articles, self.doubt = 0, 0, 0, 0, 0
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.tags, self.linked, self.current, self.doubt))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            elif tag in ("br", "wbr") and not self.skip and tag == "br":
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.end_block()
            # an open element of the same kind in the same element ends here
            if (same := AUTO_CLOSE.get(tag)) and self.open.get(same):
                for name, _, _, _ in reversed(self.stack):
                    if name == same:
                        self.handle_endtag(same)
                        break
                    if name not in INLINE and name != "p":
                        break
        named, doubtful = self._hinted(tag, attrs)
        hidden = tag in SKIPPED or (tag == "header" and not self.articles) or named
        self.stack.append((tag, self.current, hidden, self.doubt))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.skip += hidden
        if tag == "a":
            self.links += 1
        elif tag not in INLINE:
            is_article = tag in ("article", "main") or any((k == "role" and v in ("main", "article")) or (k == "itemprop" and v == "articleBody") for k, v in attrs)
            self.articles += is_article
            self.parents.append(self.current)
            self.article.append(is_article)
            self.current = len(self.parents) - 1
            if doubtful and not self.doubt:
                self.doubt = self.current

    def _hinted(self, tag, attrs) -> tuple[bool, bool]:
        """Whether an element is not the article by its role or the whole of a class name or id, and whether a part of one makes it doubtful."""
        if any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v in SKIPPED_ROLES) for k, v in attrs if tag not in ("html", "body", "main")):
            return True, False
        if tag in INLINE or tag in ("html", "body", "main"):
            return False, False
        names = {x for k, v in attrs if k in ("class", "id") and v for x in v.lower().split()}
        if not names:
            return False, False
        if tag == "article":
            return not names.isdisjoint({"comment", "comments", "ad", "related", "promo", "teaser"}), False
        return not HINTS.isdisjoint(names), not HINTS.isdisjoint(y for x in names for y in x.replace("-", " ").replace("_", " ").split())

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.open.get(tag):
            return
        if tag not in INLINE:
            self.end_block()
        while True:
            name, current, hidden, doubt = self.stack.pop()
            self.open[name] -= 1
            self.skip -= hidden
            if name == "a":
                self.links -= 1
            elif name not in INLINE:
                if name != tag:
                    self.end_block()
                self.articles -= self.article[self.current]
                self.current, self.doubt = current, doubt
            if name == tag:
                return

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def _upper_cluster(ratio: np.ndarray) -> np.ndarray:
    """Which smoothed ratios are above the threshold between the two cluster means."""
    low, high = ratio.min(), ratio.max()
    for _ in range(20):
        cut = (low + high) / 2
        up = ratio >= cut
        if up.all() or not up.any():
            break
        low2, high2 = ratio[~up].mean(), ratio[up].mean()
        if (low2, high2) == (low, high):
            break
        low, high = low2, high2
    return ratio >= (low + high) / 2


def main_text(page: str | None) -> str:
    """The blocks of the page's article, joined by line feeds."""
    if not page:
        return ""
    p = _Blocks()
    p.feed(page)
    p.close()
    p.end_block()
    if not p.blocks:
        return ""
    size = np.array([len(b[0]) - b[2] for b in p.blocks], float)
    ratio = size / np.maximum(1, [b[1] for b in p.blocks])
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    ratio = np.convolve(np.pad(ratio, RADIUS, "edge"), kernel / kernel.sum(), "valid")
    upper = _upper_cluster(ratio)
    mass, fair = np.where(upper, size, 0), ratio >= ratio[upper].mean() / 2
    within = [0.0] * len(p.parents)
    good = {0, *(doubt for (text, _, linked, _, doubt), f in zip(p.blocks, fair) if f and linked <= 0.6 * len(text))}
    for (_, _, _, at, _), m in zip(p.blocks, mass):
        within[at] += m
    for e in range(len(p.parents) - 1, 0, -1):  # children come after their parents
        within[p.parents[e]] += within[e]
    articles = [e for e in range(len(p.parents)) if p.article[e] and within[e] > 0]
    if articles:
        best = max(within[e] for e in articles)
        region = max(e for e in articles if within[e] >= MOST * best)
    else:
        region, children = 0, {}
        for e in range(1, len(p.parents)):
            children.setdefault(p.parents[e], []).append(e)
        while True:
            into = [e for e in children.get(region, ()) if within[e] >= MOST * within[0]]
            # an element with blocks of its own kind below it is a region; a lone paragraph is not
            if not into or not any(c in children for c in into):
                break
            region = into[0]
    inside = [False] * len(p.parents)
    inside[region] = True
    for e in range(region + 1, len(p.parents)):
        inside[e] = inside[p.parents[e]]
    return "\n".join(text for text, _, linked, at, doubt in p.blocks if inside[at] and doubt in good and (articles or linked <= 0.6 * len(text)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    text_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(tidy(run), "page_id bigint, url string, text string, n_chars bigint")
