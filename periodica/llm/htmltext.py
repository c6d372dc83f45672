"""Main text of web pages by templates deduced from containers that occur together.

A page is read as a sequence of containers, named by tag, class and id and by the containers
around them, with text in the slots between.  On the different pages of one host, containers
that occur on the same pages form a class; the set of pages is held as a sum of hashes, so
that hosts of any size are summed up as they are shuffled.  Classes on enough pages make the
host's templates, one for each layout: a twentieth of the pages is enough.  Where one slot of
a class changes from page to page, those of the class that never change are its template and
no article, and so is what never changes on half of the host's pages.  Each page is read by
the slots of the classes that are on it.

Classes do not tell what is in a slot: a teaser that changes on every page looks like a part
of the article.  Menus, headers, adverts and the like are known by their tags and by words of
their class or id, and articles by their tags where they have them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.llm.common import staged, text_batches

# Tags of the HTML standard.
RAW = "script|style|noscript|template|textarea|title|select|button|svg|math|iframe|object|audio|video|canvas"
CONTAINERS = frozenset(
    "article aside body details dialog div dl fieldset figure footer form head header main menu nav ol "
    "section table ul".split()
)
BLOCKS = CONTAINERS | frozenset(
    "address blockquote caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr html li p pre summary "
    "tbody td tfoot th thead tr".split()
)
# Tags and class or id words that say a container is not part of the article.
APART_TAGS = frozenset("aside dialog footer form head header menu nav".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer gdpr header legal login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion related recommended share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_TAGS = ("article", "main")

VALID_SHARE = 0.05
CONSTANT_SHARE = 0.5
CONSTANT_PAGES = 3
MOST_LABELS = 40

# A tag ends with its bracket, with the next bracket where its quotes are not closed, or with
# the page; so whatever begins one is read once.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*+(?:>|\Z).*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+|[^>]*+)(?:>|\Z)"""
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
APART = "!"  # marks the label of a container that is not part of the article
TAIL = "~"  # begins the hash of the labels that a path has no room for


def _label(tag: str, attributes: str, inside: bool = False) -> str:
    """inside: whether it is in an article or main tag; the outermost of these is never apart."""
    words = [
        word
        for _, *value in _NAMES.findall(attributes)
        for word in unescape("".join(value)).lower().split()
    ]
    named = any(part in APART_WORDS for w in words for part in re.split(r"[-_]", w))
    apart = tag in APART_TAGS or named and (inside or tag not in MAIN_TAGS)
    shown = re.sub(r"[\d/!]+", "0", ".".join([tag, *words[:2]]))[:60]
    return shown + APART * apart


@lru_cache(1 << 14)
def tagged(path: str) -> str:
    """The path as far as its first article or main tag; empty where it has none."""
    labels = path.split("/")
    for k, label in enumerate(labels):
        if label.partition(".")[0] in MAIN_TAGS:
            return "/".join(labels[: k + 1])
    return ""


def _deeper(path: str, depth: int, label: str) -> str:
    """The path one container further in.

    Below MOST_LABELS containers it ends in a hash of the others, which is marked where one of
    them is apart; the first article or main tag among them stays readable before it.
    """
    if depth < MOST_LABELS:
        return f"{path}/{label}" if path else label
    head, _, tail = path.rpartition("/")
    if not tail.startswith(TAIL):
        head, tail = path, ""
    apart = APART in tail or APART in label
    if not apart and label.partition(".")[0] in MAIN_TAGS and not tagged(path):
        head = f"{head}/{label}"
    return f"{head}/{TAIL}{hashlib.md5(f'{tail}/{label}'.encode()).hexdigest()[:16]}{APART * apart}"


def blocks(html: str) -> Iterator[tuple[str, str, int]]:
    """(path of containers, text, characters of it inside links) of every block, in order.

    Comments, markup and the content of scripts and the like are dropped; references are
    decoded; white space is one space and trimmed.
    """
    stack: list[tuple[str, str]] = []  # tags, and paths as far as them
    path, held, linked, in_link = "", [], 0, False
    at = 0

    def block():
        text = " ".join("".join(held).split())
        return (path, text, min(linked, len(text))) if text else None

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            text = unescape(html[at : token.start()])
            held.append(text)
            linked += len(text) * in_link
        at = token.end()
        closing, tag, attributes = token[2], (token[3] or "").lower(), token[4]
        if not tag:
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        if (found := block()) is not None:
            yield found
        held, linked = [], 0
        if tag not in CONTAINERS:
            continue
        if not closing:
            if not attributes.endswith("/"):
                stack.append((tag, _deeper(path, len(stack), _label(tag, attributes, bool(tagged(path))))))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    in_link = False
                    break
        path = stack[-1][1] if stack else ""
    if at < len(html):
        held.append(unescape(html[at:]))
    if (found := block()) is not None:
        yield found


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKENS = "host string, page long, path string, main string, chars long, link_chars long, words long"
_ARROW = pa.schema(
    [("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("main", pa.string()),
     ("chars", pa.int64()), ("link_chars", pa.int64()), ("words", pa.int64())]
)


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row for each page and path with text: characters, and a hash of the text.

    Containers marked as apart are left out.  page is a hash of what the page says, in its article or main tags if it has any and else
    outside containers marked as apart: pages with equal texts there are one page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
                found: dict[str, list] = {}
                free = [block for block in blocks(html or "") if APART not in block[0]]
                said = xxhash.xxh64()
                for path, text, _ in [block for block in free if tagged(block[0])] or free:
                    said.update(f"{path}\n{text}\n".encode("utf-8", "surrogatepass"))
                page = said.intdigest() - (1 << 63)
                for path, text, linked in free:
                    own = found.setdefault(path, [0, 0, xxhash.xxh64()])
                    own[0] += len(text)
                    own[1] += linked
                    own[2].update(text.encode("utf-8", "surrogatepass") + b"\n")
                for path, (chars, linked, digest) in found.items():
                    words = digest.intdigest() - (1 << 63)
                    rows.append((host, page, path, tagged(path), chars, linked, words))
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )

    return pages.select("host", "html").mapInArrow(run, TOKENS)


def templates(tokens: DataFrame) -> DataFrame:
    """host and slots: the slots of the host's templates, as the text of a JSON array.

    tokens: the rows of page_tokens.  Copies of a page are no evidence, so each host is
    reduced to its different pages first.  A slot is valid where its class is on the share
    VALID_SHARE of these, and on CONSTANT_PAGES or half of them; so a host has no more valid
    slots than twenty of its pages.  Of a slot are told: path; main, the first container of
    an article or main tag; weight, the text outside of links in the slot or in all of main;
    constant, whether its text is the template's; links, whether most of it is inside links.
    Without such tags the slot with the
    most text of the host is never constant.
    """
    tokens = tokens.groupBy("host", "page", "path", "main").agg(
        F.max("chars").alias("chars"),
        F.max("link_chars").alias("link_chars"),
        F.min("words").alias("low"),
        F.max("words").alias("high"),
    )
    sizes = tokens.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(
        F.sum("one").alias("pages")
    )
    seen = tokens.groupBy("host", "path", "main").agg(
        F.sum(F.xxhash64("page") % (1 << 40)).alias("vector"),
        F.count(F.lit(1)).alias("on_pages"),
        F.sum(F.col("chars") - F.col("link_chars")).alias("weight"),
        (2 * F.sum("link_chars") > F.sum("chars")).alias("links"),
        (F.min("low") != F.max("high")).alias("varied"),
    )
    on_pages, pages, no_main = F.col("on_pages"), F.col("pages"), F.col("main") == ""
    valid = seen.join(sizes, "host").where(
        (on_pages >= VALID_SHARE * pages)
        & ((on_pages >= CONSTANT_PAGES) | (on_pages >= CONSTANT_SHARE * pages))
    )
    most = F.max(F.struct("weight", "path", "varied"))
    ranked = valid.withColumns(
        {
            "first_of_class": most.over(Window.partitionBy("host", "vector", "on_pages")),
            "first": most.over(Window.partitionBy("host")),
            "in_main": F.sum("weight").over(Window.partitionBy("host", "main")),
        }
    )
    usual = (on_pages >= CONSTANT_SHARE * pages) & (~no_main | (F.col("path") != F.col("first.path")))
    of_class = no_main & F.col("first_of_class.varied")
    constant = ~F.col("varied") & (on_pages >= CONSTANT_PAGES) & (usual | of_class)
    slot = F.struct(
        "path",
        "main",
        F.when(no_main, F.col("weight")).otherwise(F.col("in_main")).alias("weight"),
        constant.alias("constant"),
        "links",
    )
    return ranked.groupBy("host").agg(F.to_json(F.collect_list(slot)).alias("slots"))


@lru_cache(64)
def _by_path(slots: str | None) -> dict[str, dict]:
    return {slot["path"]: slot for slot in json.loads(slots or "[]")}


def _inside(path: str, main: str) -> bool:
    return main == "" or path == main or path.startswith(main + "/")


def _around(paths: set[str]) -> str:
    """The nearest container of all the paths."""
    return "/".join(commonprefix([path.split("/") for path in paths]))


def article(html: str, slots: dict[str, dict]) -> str:
    """The blocks of the article, joined by line breaks; slots: those of the host, by path.

    Of the article or main tags of a page, that with the most text on the host is the main
    path.  A page without a valid one is read by its own article or main tag.  Without these
    tags, the main path is the nearest container of all slots that are not constant and not
    links for the most part.  Constant slots and containers marked as apart are left out.
    """
    found = [(path, text) for path, text, _ in blocks(html) if APART not in path]
    paths = {path for path, _ in found}
    mains = [(slots[p]["weight"], slots[p]["main"]) for p in paths if p in slots and slots[p]["main"]]
    if not mains and any(map(tagged, paths)):
        return "\n".join(t for p, t in found if tagged(p))
    varied = {p for p in paths if p not in slots or not slots[p]["constant"]}
    if mains:
        main = max(mains)[1]
        varied.add(main)
    else:
        main = _around({p for p in varied if p not in slots or not slots[p]["links"]} or varied or {""})
    own = [(p, t) for p, t in found if _inside(p, main)]
    # A constant slot is the article itself where nothing else is in it.
    return "\n".join([t for p, t in own if p in varied] or [t for _, t in own])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A page without html, or without text, has an empty text.  Pages without a host are a
    host of their own.  Rows with null or repeated ids are pages like any other; other
    columns are dropped; an empty table gives an empty one.  The deduced templates are
    staged, so their size decides how they meet the pages; a hot host is split by adaptive
    execution where they are too large to be sent around.
    """
    text_batches(pages.sparkSession)
    named = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    tokens = staged(page_tokens(named), "tokens")
    known = staged(templates(tokens), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                article(html or "", _by_path(slots))
                for html, slots in zip(*(batch.column(c).to_pylist() for c in ("html", "slots")))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = named.join(known, "host", "left").select(
        F.col("page_id").cast("bigint"), "url", "html", "slots"
    )
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
