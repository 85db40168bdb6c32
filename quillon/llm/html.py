"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block
has its word count and link density, those of the blocks before and after it,
and marks of the markup around it: inside an article or main element; on a page
that has one; inside an element for menus, headers, footers or asides; inside
something whose class, id or role hints at such a part; a heading. The first
article of a page starts without hints, whatever is wrapped around it. A decision
tree, grown on the labelled blocks of EXAMPLES and of the pages made in
:mod:`quillon.llm.layouts`, says which blocks are main text.

Null and empty pages have no blocks; so have pages of markup only. Unclosed and
crossed tags, cut-off pages and bad character references are read as browsers do,
nearly. Repeated rows are read alike; extra columns are kept. Whole pages are
read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import layouts
from quillon.llm.common import bounded

# HTML elements by what they do to the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol p pre section span table td th tr ul h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("script style noscript template iframe object svg math select textarea title button canvas audio video head".split())
#: Of these, those whose content is no markup: without an end tag they run to the end of the page.
RAW = frozenset("script style iframe textarea title head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside menu dialog".split())
#: Words in class, id and role that say what a part of a page is for.
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation
breadcrumb breadcrumbs sidebar side widget widgets comment comments reply replies disqus respond discussion cookie cookies consent notice
notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay
footer header masthead topbar toolbar pager pagination copyright search form hidden toc tags complementary contentinfo
dialog""".split())
#: Of these, those that count only as a whole class, id or role: in compounds they
#: often say how something looks ("text-side") or what it is about ("search-results").
WHOLE = frozenset("side form search hidden share alert related menu login".split())
MAIN = frozenset("article main articlebody post-content entry-content article-content article-body story-body".split())

PARTS = HINTS - WHOLE

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)")
ATTR = re.compile(r"""([a-zA-Z_:-][a-zA-Z0-9_:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = ("words", "links", "words before", "links before", "words after", "links after", "in article", "page has article", "in aside", "hinted", "heading")

#: Labelled blocks: small pages in which ``data-keep`` marks the main text.
EXAMPLES = (
    """<body><header><h1>The Daily Site</h1><p>News and views from around the whole country since 1980</p></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>World news</a></li><li><a href=3>About us</a></li></ul></nav>
    <div class="ad">Buy new shoes now at half price this week only in all shops of the town</div><article><h1 data-keep>Rain in the hills</h1><p data-keep>It rained for three days in the hills and the river rose over its banks.</p><p data-keep>Short.</p><p data-keep>People
    moved to the school, where food and blankets were given out all night by those who live near it and by many others too.</p><p data-keep>It is over now.</p></article><aside><p>Most read: a long list of what others have read in the last days and liked</p></aside>
    <footer>&copy; The Daily Site. All rights reserved by the owners of this site and by its writers.</footer></body>""",
    """<body><div id="nav"><a href=1>Home</a> <a href=2>Shop</a> <a href=3>Contact</a></div><div id="cookie-notice">We use cookies to make this site better for you and for those who advertise here, please accept them.</div>
    <div class="content"><h2 data-keep>How to bake bread at home</h2><p data-keep>Mix flour, water, salt and yeast in a large bowl until it all comes together as a dough and no dry flour is left.</p><p data-keep>Let it rest for twelve hours
    under a cloth, then shape it and bake it in a very hot pot with its lid on for half an hour.</p><p data-keep>Take the lid off and bake for some fifteen minutes more, until the crust is dark and sounds hollow when knocked.</p></div>
    <div class="sidebar"><h3>About me</h3><p>I bake bread and write about it in this blog for friends and for all who like to read of it on slow days.</p></div>
    <div class="comments"><h3>Comments</h3><p>I tried this at home with my children and it was the best bread that we have eaten in years, thank you so much!</p><p>Nice.</p></div></body>""",
    """<body><nav><a href=1>A</a><a href=2>B</a></nav><main><h1 data-keep>Notes</h1><p data-keep>One.</p><p data-keep>Two words.</p><ul><li data-keep>First point of the list</li><li data-keep>Second</li></ul><p data-keep>See <a href=3>the paper</a> for more on how the measure was taken and by whom.</p>
    <form><p>Leave your address to get our letter each week with all that is new on this site and others</p><label>Name</label></form><div class="share"><a href=4>Send</a> <a href=5>Print</a></div></main><footer><p>Imprint</p></footer></body>""",
    """<body><div class="menu"><ul><li><a href=1>Start</a></li><li><a href=2>Forum</a></li></ul></div><table><tr><td data-keep>The old bridge was built of stone by the monks who lived on the far side, and it stood for six hundred years until the flood.</td></tr><tr><td data-keep>A new one was built
    of iron a little way down the stream, where the banks are higher and the road is straight, and it is used to this day.</td></tr></table><p><a href=3>Next</a> | <a href=4>Back</a></p><p><a href=5>More on bridges</a> <a href=6>More on rivers</a></p><p>Copyright 2001</p></body>""",
    """<body><article><header><h1 data-keep>Votes are in</h1></header><p data-keep>All votes have been counted.</p><div class="advert"><p>Win a trip for two to the sea, with food and hotel and all you can wish for</p></div><p data-keep>The mayor stays, with a small lead, said the town clerk late on Sunday to those who waited in the hall.</p><p data-keep>Fin</p>
    <section id="comments"><p>The town clerk should have said so much sooner, as we all had been waiting there in the cold for many hours</p></section></article><div class="related"><p>Other articles that readers of this one have also read and liked a lot lately</p></div></body>""",
    """<body><div class="notice">The site will be down for repairs on Monday night from ten to twelve, we are sorry for that.</div><article><p data-keep><a href=1>All of it is a link to the source that the author took it from</a></p><p data-keep>Yes.</p><h2 data-keep>Part two</h2><p data-keep>And so it went on, for as long as anyone there could remember, until one day the well was dry.</p></article>
    <div class="ad">Shoes</div><div>Terms</div><div><a href=9>Privacy</a></div></body>""",
    """<body><article><h1 data-keep>Alone</h1><p data-keep>Only this.</p><p data-keep>And that.</p></article></body>""",
    """<body><p data-keep>A page that has one paragraph of plain text, with neither head nor menu nor foot to it, is all main text.</p></body>""",
    """<body><main><p data-keep>Brief.</p></main></body>""",
    """<body><article><p data-keep>Bare text in an article at the very start of a page is main text as well.</p></article><p><a href=1>Up</a></p></body>""",
)


@dataclass
class Block:
    parts: list = field(default_factory=list)
    linked: list = field(default_factory=list)
    article: bool = False
    aside: bool = False
    hinted: bool = False
    heading: bool = False
    keep: bool = False


def _close(source: str, low: str, tag: str, at: int) -> int:
    """Where the content of a skipped element ends."""
    end = low.find(f"</{tag}", at)
    return len(source) if end < 0 else end


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is an article, an aside, hints at a part that is none, and
    is marked as kept."""
    article, aside, hint, keep = tag in ("article", "main"), tag in ASIDE and not (tag == "header" and in_article), tag == "form", False
    if attrs:
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "itemprop"):
                words = value.split()
                article = article or not MAIN.isdisjoint(words)
                if tag not in ("body", "html", "main"):
                    hint = hint or any(w in HINTS or not PARTS.isdisjoint(re.split(r"[-_:]", w)) for w in words if w not in MAIN)
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                aside = True
            elif name == "data-keep":
                keep = True
    return article and not (hint and tag == "article"), aside, hint, keep


def blocks(source: str | None) -> list[tuple[str, tuple, bool]]:
    """(text, features, marked as kept) of the blocks of a page, in order."""
    source = source or ""
    low, found, now = source.lower() if source.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), source), [], Block()
    stack: list[tuple] = []  # tag, article, aside, hint, keep
    inside = [0, 0, 0, 0, 0]  # open elements that are articles, asides, hints, kept, headings
    outer = 0  # hints around the first article, which do not count in it
    articles = 0
    there: Counter = Counter()  # open elements by tag
    links, at, n = 0, 0, len(source)
    unclosed: set[str] = set()

    def push(tag: str, *marks: bool) -> None:
        nonlocal outer, articles
        if marks[0]:
            articles += 1
            if articles == 1:
                outer, inside[2] = inside[2], 0
                marks = (True, *marks[1:2], False, *marks[3:])
        stack.append((tag, *marks))
        there[tag] += 1
        for i, on in enumerate((*marks, tag in HEADINGS)):
            inside[i] += on

    def pop() -> str:
        tag, *marks = stack.pop()
        there[tag] -= 1
        nonlocal outer
        for i, on in enumerate((*marks, tag in HEADINGS)):
            inside[i] -= on
        if marks[0] and not inside[0]:
            inside[2], outer = inside[2] + outer, 0
        return tag

    def text(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if links:
                now.linked.append(raw)

    def end() -> None:
        nonlocal now
        whole = " ".join(html.unescape("".join(now.parts)).split())
        if whole:
            linked = len(html.unescape("".join(now.linked)).split())
            found.append((whole, now, linked))
        now = Block(article=inside[0] > 0, aside=inside[1] > 0, hinted=inside[2] > 0, heading=inside[4] > 0, keep=inside[3] > 0)

    while at < n:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        text(source[at:start])
        m = TAG.match(source, start) or LOOSE.match(source, start)
        if not m:
            text("<")
            at = start + 1
            continue
        at = m.end()
        if m.lastindex is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if not closing and tag in SKIPPED and not m[0].endswith("/>"):
            if tag not in RAW and (tag in unclosed or low.find(f"</{tag}", at) < 0):
                unclosed.add(tag)
                # left open: aside up to the end of its parent or the next block
                end()
                push(tag, False, True, False, False)
                end()
                continue
            if tag == "head" and (body := low.find("<body", at)) >= 0 and (low.find("</head", at) < 0 or body < low.find("</head", at)):
                at = body
            else:
                at = _close(source, low, tag, at)
            continue
        if tag in SKIPPED:
            continue
        if tag in BLOCKS and tag != "option" and stack and stack[-1][0] in SKIPPED:
            while stack and stack[-1][0] in SKIPPED:
                pop()
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag in ("br", "img", "input"):
            text(" ")
        if tag in CONTAINERS and tag not in VOID:
            if closing:
                if there[tag]:
                    while pop() != tag:
                        pass
            else:
                if tag in ("p", "li", "td", "th", "tr") or tag in HEADINGS:
                    same = {"p": ("p",), "li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p")}.get(tag, ("p",))
                    while stack and stack[-1][0] in same:
                        pop()
                elif stack and stack[-1][0] == "p" and tag != "span":
                    pop()
                push(tag, *_marks(tag, m[3], inside[0] > 0))
        if tag in BLOCKS:
            end()
    end()

    counted = [(len(t.split()), k) for t, _, k in found]
    density = [k / w if w else 0.0 for w, k in counted]
    out = []
    for i, (t, b, _) in enumerate(found):
        before = (counted[i - 1][0], density[i - 1]) if i else (0, 0.0)
        after = (counted[i + 1][0], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((t, (counted[i][0], density[i], *before, *after, float(b.article), float(articles > 0), float(b.aside), float(b.hinted), float(b.heading)), b.keep))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple:
    """A decision tree by least Gini impurity: (share of main, feature,
    threshold, below, above) or (share,)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n, k = np.arange(1, len(v)), ones[:-1]
        left, right = k / n, (ones[-1] - k) / (len(v) - n)
        cost = n * left * (1 - left) + (len(v) - n) * right * (1 - right)
        cost = np.where(v[1:] > v[:-1], cost, np.inf)
        if len(cost) and cost.min() < best[0] - 1e-12:
            i = int(cost.argmin())
            best = (float(cost[i]), f, float((v[i] + v[i + 1]) / 2))
    if not np.isfinite(best[0]):
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (share, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def verdict(tree: tuple, features: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[3] if features[tree[1]] <= tree[2] else tree[4]
    return tree[0] >= 0.5


@functools.lru_cache(maxsize=1)
def trained(examples: tuple[str, ...] = EXAMPLES) -> tuple:
    """The tree grown on the blocks of the examples and of the pages made from layouts."""
    rows = [b for page in (*examples, *layouts.pages()) for b in blocks(page)]
    return grow(np.array([f for _, f, _ in rows]), np.array([k for _, _, k in rows], dtype=float))


def main_blocks(source: str | None, tree: tuple | None = None) -> list[str]:
    tree = tree or trained()
    return [t for t, f, _ in blocks(source) if verdict(tree, f)]


def extracted(pages: DataFrame, source: str = "html", into: str = "main_blocks") -> DataFrame:
    """``pages`` with a column ``into``: the texts of the main blocks, in order; a
    column of that name is replaced."""

    tree = trained()

    @F.pandas_udf("array<string>")
    def read(sources: pd.Series) -> pd.Series:
        return pd.Series([main_blocks(s, tree) for s in sources], dtype="object")

    found: Column = read(F.col(source))
    return bounded(pages).withColumn(into, found)
