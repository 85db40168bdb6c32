"""Trimming, braces in strings and faulty constants of templates."""

import pytest

from quillon.llm import chat


@pytest.mark.parametrize("source, want", [
    ("a {{- x -}} b", "aXb"), ("a {{ x -}} \n b", "a Xb"), ("a \n {{- x }} b", "aX b"), ("a {%- if x -%} y {%- endif -%} b", "ayb"), ("a {#- no -#} b", "ab"),
    ("{{ '}}' }}", "}}"), ("{{ '%}' ~ x }}{% set y = '%}' %}{{ y }}", "%}X%}"), ('{{ "it\'s -}}" }}', "it's -}}"), ("{{ x }}-{{ x }}", "X-X"), ("{{ '-' }}", "-"),
])
def test_pieces(source, want):
    assert chat.compile_template(source)(x="X")[0] == want


@pytest.mark.parametrize("source", ["{{ 1 < 'a' }}", "{% if 1 < 'a' %}x{% endif %}", "{{ 1|length }}"])
def test_constants_that_do_not_fit(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)
