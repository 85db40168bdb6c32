"""Main text against a second extractor, unseen pages and layouts, and odd tables."""

import html as stdlib
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import html, layouts, queries

BREAKS = set("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br".split())


class Slow(HTMLParser):
    """Text inside the first article, without its asides and parts named so."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skipped, self.out, self.seen = 0, None, [], False

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.out.append(" ")
        if tag in ("script", "style", "nav", "aside", "footer", "form") or any(re.search(r"\b(ad|comments?|share|related)\b", v or "") for k, v in attrs if k in ("class", "id")):
            self.skipped = self.skipped or tag
        if tag == "article":
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.out.append(" ")
        if tag == self.skipped:
            self.skipped = None
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth > 0 and not self.skipped:
            self.out.append(data)


def slow_text(source):
    p = Slow()
    p.feed(source or "")
    p.close()
    return " ".join("".join(p.out).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_second_extractor(spark, sf):
    path = f"/root/testdata/{sf}"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = queries.op3_main_text(spark, path).collect()
    assert {r["page_id"] for r in got} == set(pages)
    assert not [r["page_id"] for r in got if r["text"] != slow_text(pages[r["page_id"]]) or r["n_chars"] != len(r["text"])]


def judged(pages, tree):
    rows = [(html.verdict(tree, f), k) for p in pages for _, f, k in html.blocks(p)]
    both = sum(a and b for a, b in rows)
    return both / max(1, sum(a for a, _ in rows)), both / max(1, sum(b for _, b in rows))


def test_unseen_pages_of_the_layouts():
    assert min(judged(layouts.pages(12, seed=99), html.trained())) > 0.99


def test_unseen_layouts(monkeypatch):
    """Each layout in turn is left out of the labelled table."""
    found = []
    for i, layout in enumerate(layouts.LAYOUTS):
        rest = [layouts.page(x, 31 * j + n) for j, x in enumerate(layouts.LAYOUTS) if j != i for n in range(6)]
        rows = [b for p in (*html.EXAMPLES, *rest) for b in html.blocks(p)]
        tree = html.grow(np.array([f for _, f, _ in rows]), np.array([k for _, _, k in rows], dtype=float))
        found.append(judged([layouts.page(layout, 5000 + n) for n in range(20)], tree))
    precision, recall = np.mean(found, axis=0)
    print(precision, recall)
    assert precision > 0.9 and recall > 0.9


def test_words_and_links_decide():
    """Without any mark of the markup the same block is main text or not by its words, links and neighbours."""
    tree, used = html.trained(), set()

    def walk(t):
        if len(t) > 1:
            used.add(html.NAMES[t[1]])
            walk(t[3])
            walk(t[4])

    walk(tree)
    assert {"words", "links"} <= used and used & {"words before", "words after", "links before", "links after"}
    assert html.NAMES[tree[1]] in ("words", "links")


WORDS = "The bridge was built of stone by those who lived on the far side, and it stood until the flood."


@pytest.mark.parametrize("page, kept", [
    (f"<div class='promo-free-layout'><article><h1>Title</h1><p>{WORDS}</p></article></div>", f"Title {WORDS}"),
    (f"<section class='discussion'><article><h1>Title</h1><p>{WORDS}</p></article></section>", f"Title {WORDS}"),
    (f"<form id=f><article><p>{WORDS}</p></article></form><footer>All rights reserved.</footer>", WORDS),
    (f"<article><p>{WORDS}</p></article><section id='comments'><article class='comment'><p>{WORDS} So say I, and many others who were there.</p></article></section>", WORDS),
    (f"<article><p>{WORDS}</p></article><div class='related'><article><h3>Another bridge</h3><p>{WORDS}</p></article></div>", WORDS),
])
def test_names_around_an_article(page, kept):
    assert " ".join(html.main_blocks(page)) == kept


def test_odd_tables(spark):
    kind = "page_id long, url string, html string, main_blocks int, text int, n_chars int"
    assert html.extracted(spark.createDataFrame([], kind)).count() == 0
    long = "<article>" + f"<p>{WORDS}</p>" * 40_000 + "</article><footer>x</footer>"
    assert len(long) > 3_000_000
    rows = spark.createDataFrame([(1, "u", long, 1, 2, 3), (1, "u", None, 1, 2, 3), (None, None, "", 1, 2, 3)], kind)
    got = html.extracted(rows).select("page_id", "text", F.size("main_blocks"), F.length(F.array_join("main_blocks", " "))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 40_000, 40_000 * (len(WORDS) + 1) - 1), (1, 2, 0, 0), (None, 2, 0, 0)], key=str)


def test_references_are_decoded_once():
    assert " ".join(html.main_blocks("<article><p>a &amp;lt; b &#x41;&nbsp;c</p></article>")) == " ".join(stdlib.unescape("a &amp;lt; b &#x41; c").split())
