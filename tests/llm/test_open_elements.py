"""Skipped elements that a page leaves open."""

import pytest

from quillon.llm import html

REST = "The bridge was built of stone by those who lived on the far side and it stood until the flood."


@pytest.mark.parametrize("tag", ["button", "select", "svg", "math", "object", "canvas", "audio", "video", "template"])
@pytest.mark.parametrize("page", ["<article><p>Kept first.<{0}>Share</p><p>{1}</p></article>", "<article><p>Kept first.</p><{0} class=x>Share<p>{1}</p></article>", "<article><p>Kept first.</p><div><{0}><span>Share</span></div><p>{1}</p></article>"])
def test_open_element_does_not_swallow_the_page(tag, page):
    assert " ".join(html.main_blocks(page.format(tag, REST))) == f"Kept first. {REST}"


@pytest.mark.parametrize("tag", ["script", "style", "textarea"])
def test_open_raw_text_runs_to_the_end(tag):
    assert html.main_blocks(f"<article><p>Kept first.</p><{tag}>x<p>{REST}</p></article>") == ["Kept first."]


def test_open_select_has_no_options_in_the_text():
    assert " ".join(html.main_blocks(f"<article><p>Kept first.</p><div><select><option>One<option>Two</div><p>{REST}</p></article>")) == f"Kept first. {REST}"
