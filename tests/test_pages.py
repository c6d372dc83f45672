"""Extraction of embedded documents, and character references."""

import html
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from periodica.functions.text import html_unescape
from periodica.sources import documents, pages
from tests.test_documents import doc


def island(data, name="Record", tag="x-island", quote='"', first=True):
    text = html.escape(data if isinstance(data, str) else json.dumps({"data": data}))
    attributes = [f"props={quote}{text}{quote}", f"name={quote}{name}{quote}"]
    return f"<{tag} class=a {' '.join(attributes[:: 1 if first else -1])}></{tag}>"


def test_documents_and_rejects(spark, tmp_path):
    tricky = doc("tricky", name='name="Record" > & "quoted" <b>')
    cases = {
        "plain": island(doc("plain")),
        "name first": island(doc("name first"), first=False),
        "single quotes": island(doc("single quotes"), quote="'"),
        "second island": island(doc("wrong"), name="Other") + island(doc("second island")),
        "other tag": island(doc("wrong"), tag="x-islands") + island(doc("other tag")),
        "tricky": island(tricky),
        "no island": "<p>nothing</p>",
        "no props": '<x-island name="Record"></x-island>',
        "cut": island('{"data": {"creator"'),
        "no creator": island(doc("no creator", creator=...)),
        "no data": island('{"other": 1}'),
        "trailing": island(json.dumps({"data": doc("trailing")}) + " more"),
        "two": island(json.dumps({"data": doc("two")}) * 2),
        "twice": island('{"data":null,"data":' + json.dumps(doc("twice")) + "}"),
    }
    df = spark.createDataFrame([(k, f"<html>{v}</html>") for k, v in cases.items()], "url string, html string")
    found, rejected = pages.page_props(df, "x-island", "Record", str(tmp_path / "props"))
    assert {r.url: r.id for r in found.collect()} == {
        k: k for k in ("plain", "name first", "single quotes", "second island", "other tag", "tricky", "twice")
    }
    assert {r.url: r.reason for r in rejected.collect()} == {
        "no island": "no props", "no props": "no props", "cut": "not JSON", "trailing": "not JSON",
        "two": "not JSON",
        "no creator": "no creator", "no data": "no creator",
    }
    names = {r.id: r.name for r in documents.puzzle_norm(found).collect()}
    assert names["tricky"] == 'name="Record" > & "quoted" <b>'


def test_props_are_unescaped_twice(spark, tmp_path):
    data = doc("x", name="Fish &amp; chips &#233;")
    found, _ = pages.page_props(
        spark.createDataFrame([("u", island(data))], "url string, html string"), "x-island", "Record",
        str(tmp_path / "props"),
    )
    assert found.first().name == "Fish & chips é"


def unescaped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.y for r in df.select("i", html_unescape(F.col("x")).alias("y")).orderBy("i").collect()]


KNOWN = [
    "a &amp; b", "&amp;quot;", "&#39;x&#x27;y", "&eacute;t&eacute;", "&copy 2020", "&notit;", "&notin;",
    "&#0;&#128;&#xD800;&#x110000;&#99999999999999999999;&#x1F600;", "&&;&x;&#;&#x;", "plain", "",
    "&lt;b&gt;&apos;", "&am&quot;p;", "&#38;amp;", "&#xFFFE;z&#xfdd0;", "&AMP;&Amp;", "&#13;&#1;&#x9f;",
    "&frac12;&hellip;&NotEqualTilde;", "&amp;copy;&copy;", "&#000000000000000000065;", "&quot&quot;",
]


def test_known_references(spark):
    assert unescaped(spark, KNOWN) == [html.unescape(x) for x in KNOWN]


def test_any_mixture_of_references(spark):
    parts = st.sampled_from(
        ["&", ";", "#", "x", "amp", "lt", "quot", "copy", "eacute", "39", "41", "1F600", " ", "é", "&amp;",
         "&lt;", "&quot;", "&#", "&#x", "&copy"]
    )
    texts = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(st.lists(parts, max_size=12))
    def collect(pieces):
        texts.append("".join(pieces))

    collect()
    got = unescaped(spark, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []


def test_titles_and_items(spark):
    page = ('<HTML class=x LANG=fr><head><title id="t">A &amp;\n B</title></head>'
            "<ul><li>one</li><LI class='k'>two <b>x</b></LI><link>no</link></ul>")
    row = spark.createDataFrame([(page,)], "h string").select(
        pages.page_title(F.col("h")), pages.page_lang(F.col("h")), pages.list_items(F.col("h"))
    ).first()
    assert tuple(row) == ("A &\n B", "fr", ["one", "two <b>x</b>"])
