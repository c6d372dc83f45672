"""Documents embedded in web pages: the JSON island and the accessible grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.json import closed, is_one_value
from periodica.functions.text import html_unescape
from periodica.operators.grids import blanks_fingerprint
from periodica.sources.documents import parse_json

_ATTRIBUTE = r"""\s+[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""


def attribute(attributes: Column, name: str) -> Column:
    """Raw value of the first attribute of a name in a tag; NULL if absent."""
    each = F.regexp_extract_all(attributes, F.lit(f"({_ATTRIBUTE})"), F.lit(1))
    named = F.filter(each, lambda a: a.rlike(rf"(?i)\A\s+{name}\s*="))
    value = F.regexp_extract(F.try_element_at(named, F.lit(1)), r"(?s)=\s*(.*)\z", 1)
    return F.regexp_replace(value, r"""\A["']|["']\z""", "")


def tag_attributes(page: Column, tag: str) -> Column:
    """Attribute texts of all opening tags of a kind, in page order."""
    return F.regexp_extract_all(page, F.lit(rf"(?i)<{tag}(?=[\s/>])((?:{_ATTRIBUTE})*)"), F.lit(1))


def page_title(page: Column) -> Column:
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return html_unescape(title)


def page_lang(page: Column) -> Column:
    return F.coalesce(attribute(F.get(tag_attributes(page, "html"), F.lit(0)), "lang"), F.lit(""))


def list_items(page: Column) -> Column:
    """Inner HTML of every list item, in page order."""
    return F.regexp_extract_all(page, F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"), F.lit(1))


def page_props(
    pages: DataFrame,
    tag: str,
    name: str,
    path: str,
    html: str = "html",
    keep: tuple[str, ...] = ("url",),
) -> tuple[DataFrame, DataFrame]:
    """Documents from the ``props`` of the first ``<tag name="...">`` of each page.

    The value is unescaped as an attribute and then once more as a text, read
    once, and its ``data`` taken.  Returns the documents, and the pages rejected
    with the reason: no such props, not JSON (or more than one value), or no
    creator in the data.  Both come from one table of props stored at ``path``.
    """
    island = F.filter(
        tag_attributes(F.col(html), tag), lambda a: attribute(a, "name") == name
    )
    found = pages.select(*keep, F.try_element_at(island, F.lit(1)).alias("_island"))
    raw = found.select(*keep, attribute(F.col("_island"), "props").alias("_raw"))
    once = raw.select(*keep, html_unescape(F.col("_raw")).alias("_once"))
    # Exploding a single element keeps the steps below on the finished text;
    # they would otherwise unescape the page again for each use.
    opened = once.select(*keep, F.explode(F.array(html_unescape(F.col("_once")))).alias("_props"))
    read = opened.select(*keep, "_props", closed(F.col("_props")).alias("_read"))
    data = F.from_json(F.get("_read", 0), "data string")["data"]
    judged = read.select(
        *keep,
        F.col("_props").isNull().alias("_none"),
        (~is_one_value(F.col("_props"), F.col("_read"))).alias("_other"),
        F.explode(F.array(data)).alias("_data"),
    )
    has_creator = F.array_contains(F.json_object_keys("_data"), "creator")
    reason = (
        F.when(F.col("_none"), "no props")
        .when(F.col("_other"), "not JSON")
        .when(~F.coalesce(has_creator, F.lit(False)), "no creator")
    )
    judged = judged.select(*keep, "_data", reason.alias("reason"))
    judged.write.mode("overwrite").parquet(path)
    known = judged.sparkSession.read.schema(judged.schema).parquet(path)
    documents = parse_json(known.where("reason is null").select(*keep, "_data"), "_data")
    return documents, known.where("reason is not null").select(*keep, "reason")


def accessible_fingerprint(
    page: Column, row_class: str, n_rows: int = 15, n_cols: int = 15
) -> Column:
    """Grid fingerprint of a page that lists the blank cells of every row.

    Rows are list items of the given class holding "...: A C E"; reading stops at
    the first item without a colon.
    """
    items = F.regexp_extract_all(
        page,
        F.lit(
            rf"""(?is)<li(?=[^>]*\sclass\s*=\s*["'][^"']*\b{row_class}\b)[^>]*>(.*?)</li>"""
        ),
        F.lit(1),
    )
    plain = F.transform(items, lambda t: F.when(t.contains(":"), t).otherwise(F.lit(None)))
    stop = F.array_position(F.transform(plain, lambda t: t.isNull()), True)
    used = F.when(stop > 0, F.slice(plain, F.lit(1), (stop - 1).cast("int"))).otherwise(plain)
    letters = F.transform(used, lambda t: F.regexp_extract(t, r"(?s):\s*(.*)\z", 1))
    return blanks_fingerprint(letters, n_rows, n_cols)
