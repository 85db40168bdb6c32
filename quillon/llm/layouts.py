"""Labelled web pages for the tree of :mod:`quillon.llm.html`, made from layouts.

A layout is a page with places for words: ``(12-60)`` stands for so many words and
``{...}*2-6`` repeats what is in braces so often. ``data-keep`` marks main text.
About a third of the layouts name their parts, a third do not, and the rest name them
for looks, so that a name is one hint among several and counts of words and links
of a block and its neighbours have to tell the rest. Lengths and words are drawn anew
for each page, by a seed.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "ba co di fe gu la mi no pa re si to un ve zo an el or is am".split()

LAYOUTS = (
    # parts by element
    "<body><header><h1>(1-4)</h1><p>(4-14)</p></header><nav><ul>{<li><a href=x>(1-3)</a></li>}*3-9</ul></nav><main><h1 data-keep>(3-10)</h1>{<p data-keep>(8-90)</p>}*2-8<p data-keep>(1-6)</p></main><aside><h3>(1-4)</h3>{<p>(5-40)</p>}*1-3</aside><footer><p>(4-20)</p></footer></body>",
    "<body><nav>{<a href=x>(1-2)</a> }*3-8</nav><article><header><h1 data-keep>(2-9)</h1></header>{<p data-keep>(5-80)</p>}*1-6<h2 data-keep>(1-5)</h2><ul>{<li data-keep>(1-20)</li>}*2-6</ul><blockquote><p data-keep>(6-40)</p></blockquote></article><form><p>(3-20)</p><label>(1-2)</label></form><footer>(3-18)</footer></body>",
    "<body><article><h1 data-keep>(2-8)</h1>{<p data-keep>(1-5)</p>}*1-4</article><footer><p><a href=x>(1-2)</a> <a href=x>(1-2)</a></p></footer></body>",
    # parts by name
    "<body><div class='masthead'><p>(3-12)</p></div><div id='navbar'>{<a href=x>(1-2)</a> }*3-8</div><div class='ad'>(3-30)</div><article><h1 data-keep>(3-10)</h1>{<p data-keep>(6-90)</p>}*2-7<div class='advert'><p>(5-30)</p></div>{<p data-keep>(2-60)</p>}*1-3</article><div class='ad-box'>(2-20)</div><div id='footer'>(3-16)</div></body>",
    "<body><div class='cookie-notice'>(8-40)</div><main><h2 data-keep>(3-9)</h2>{<p data-keep>(6-70)</p>}*2-6<p data-keep>(3-12) <a href=x>(1-4)</a> (3-12)</p><section class='comments'><h3>(1-3)</h3>{<p>(3-60)</p>}*1-6</section></main><div class='sidebar'>{<p>(4-40)</p>}*1-4</div></body>",
    "<body><div class='menu'>{<li><a href=x>(1-3)</a></li>}*3-7</div><article><h1 data-keep>(2-8)</h1>{<p data-keep>(10-80)</p>}*2-6<div class='share'><a href=x>(1-1)</a> <a href=x>(1-1)</a></div></article><section id='comments'>{<article class='comment'><p>(3-50)</p></article>}*1-5</section><div class='related'>{<article><h3>(2-6)</h3><p>(6-25)</p></article>}*2-4</div></body>",
    # names that are about looks, around the main text
    "<body><div class='promo-free-layout'><article><h1 data-keep>(3-9)</h1>{<p data-keep>(8-90)</p>}*2-7</article></div><div class='x1'>{<a href=x>(1-3)</a> }*2-6</div></body>",
    "<body><section class='discussion'><article><h1 data-keep>(3-9)</h1>{<p data-keep>(4-90)</p>}*2-7<p data-keep>(1-4)</p></article></section><footer>(3-14)</footer></body>",
    "<body><form id='form1'><main><h1 data-keep>(3-9)</h1>{<p data-keep>(8-70)</p>}*2-6</main></form><p><a href=x>(1-2)</a> | <a href=x>(1-2)</a></p></body>",
    # neither: words and links alone
    "<body><div class='c1'>{<p><a href=x>(1-3)</a></p>}*3-8</div><div class='c2'><h1 data-keep>(3-9)</h1>{<p data-keep>(14-90)</p>}*3-8</div><div class='c3'><p><a href=x>(1-2)</a> <a href=x>(1-3)</a></p><p>(1-4)</p></div></body>",
    "<body><table><tr><td>{<a href=x>(1-2)</a><br>}*3-8</td><td data-keep><p>(15-90)</p><p>(15-80)</p><p>(15-80)</p></td></tr><tr><td><p>(1-5)</p></td></tr></table></body>",
    "<body><div>{<li><a href=x>(2-5)</a></li>}*4-9</div><div>{<p data-keep>(18-90)</p>}*3-8<p data-keep>(12-30) <a href=x>(1-3)</a> (12-30)</p></div><div>{<div><a href=x>(3-7)</a></div>}*2-6</div><div>(1-5)</div></body>",
    "<body>{<p data-keep>(12-90)</p>}*1-5</body>",
)


def page(layout: str, seed: int) -> str:
    rng = random.Random(seed)
    drawn = lambda m: rng.randint(int(m[-2]), int(m[-1]))
    again = lambda m: m[1] * drawn(m.groups())
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    out = re.sub(r"\{(.*?)\}\*(\d+)-(\d+)", again, layout)
    return re.sub(r"\((\d+)-(\d+)\)", lambda m: " ".join(word() for _ in range(drawn(m.groups()))), out)


def pages(each: int = 6, seed: int = 1) -> tuple[str, ...]:
    """``each`` pages of every layout."""
    return tuple(page(layout, seed * 1_000_003 + i * 1009 + n) for i, layout in enumerate(LAYOUTS) for n in range(each))
