"""Pages that are cut off, and articles whose own class has a word of other containers."""

import time

import pytest

from periodica.llm.htmltext import article


@pytest.mark.parametrize("part", ["<a ", "<a", "<!", "<script ", '<a x="', "<p <q '"])
def test_unclosed_tags_are_read_once(part):
    begin = time.time()
    assert article("<p>kept</p>" + part * (1_000_000 // len(part)), {}) == "kept"
    assert time.time() - begin < 10


def test_a_tag_cut_off_is_no_text():
    assert article('<p>one</p><p>two <a href="x', {}) == "one\ntwo"


@pytest.mark.parametrize("name", ["post widget-post", "legal-news", "share"])
def test_the_class_of_an_article_does_not_empty_it(name):
    assert article(f'<article class="{name}"><p>kept</p></article>', {}) == "kept"
    assert article(f'<main><p>kept</p><article class="{name}"><p>gone</p></article></main>', {}) == "kept"
