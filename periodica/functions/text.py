"""Text column functions.  Everything is a built-in expression; no Python UDF."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

# White space as the reference patterns understand it (Java's \s adds \x0B).
WS = r"[\t\n\f\r ]"

# ---- fixed values: these patterns decide which clues count as real ones ----
LENGTH_ONLY = r"\s+\(\d+\)"
CROSS_REFERENCE = r"See\s+\d+.*"
SPECIAL_REFERENCE = r"See\s+(clues|special)\s+.*"
LINK_NOTICE = r"Follow\s+the\s+link\s+below\s+to\s+see\s+today's\s+clues.*"
PLACEHOLDERS = (LENGTH_ONLY, CROSS_REFERENCE, SPECIAL_REFERENCE, LINK_NOTICE)
LENGTH_HINT = r"\s*\([\d,\-]+\)\s*"
# ----------------------------------------------------------------------------


def portable(pattern: str) -> str:
    """Spell ``\\s`` and ``.`` out, so that they mean the same in Java's dialect."""
    return pattern.replace(r"\s", WS).replace(".*", r"[^\n]*")


def full_match(text: Column, *patterns: str) -> Column:
    """True when the whole text matches one of the patterns."""
    body = "|".join(f"(?:{portable(p)})" for p in patterns)
    return text.rlike(rf"\A(?:{body})\z")


def is_placeholder(clue: Column) -> Column:
    """Blank clues, bare length hints, unresolved references and notices."""
    return full_match(clue, "", *PLACEHOLDERS)


def strip_hint(clue: Column) -> Column:
    """Drop the length hint at the end and the spaces around the rest."""
    return F.trim(F.regexp_replace(clue, rf"{portable(LENGTH_HINT)}\z", ""))


def right_trim(text: Column) -> Column:
    """Remove spaces and tabs at the end."""
    return F.regexp_replace(text, r"[ \t]+\z", "")


def anchor(href: Column, label: Column) -> Column:
    """An HTML link; NULL when either part is NULL."""
    return F.concat(F.lit('<a href="'), href, F.lit('">'), label, F.lit("</a>"))


def _json_map(pairs: dict[str, str]) -> Column:
    """A constant map column, sent to the JVM as one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _numbered_character(code: Column) -> Column:
    """The character a numeric reference stands for, by the HTML 5 rules."""
    low = _json_map({str(i): html.unescape(f"&#{i};") for i in range(0xA0)})
    unassignable = code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    four_bytes = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return (
        F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code < 0xA0, low[code.cast("string")])
        .when(unassignable, "")
        .otherwise(F.decode(four_bytes, "UTF-32"))
    )


def html_unescape(text: Column) -> Column:
    """Replace character references in one pass, left to right.

    Nearly all references are the five basic ones, which plain replacement
    covers.  Four of them produce no ampersand and so cannot make up a new
    reference; texts in which then only ``&amp;`` is left need one replacement
    more, and the others are decoded piece by piece.
    """
    for name, sign in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return _once(
        text,
        lambda t: F.when(F.instr(t, "&") == 0, t)
        .when(~t.rlike("&(?!amp;)"), F.replace(t, F.lit("&amp;"), F.lit("&")))
        .otherwise(_unescape_pieces(t)),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unescape_pieces(text: Column) -> Column:
    """Cut at each ampersand and decode the head of every piece.

    A reference that the decoding itself produces is not decoded again.
    """
    closed = _json_map({n[:-1]: v for n, v in html5.items() if n.endswith(";")})
    open_names = {n: v for n, v in html5.items() if not n.endswith(";")}
    longest_first = "|".join(sorted(open_names, key=len, reverse=True))
    open_map = _json_map(open_names)

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, r"\A([A-Za-z][A-Za-z0-9]*);", 1)
        prefix = F.regexp_extract(part, rf"\A({longest_first})", 1)
        after_name = F.regexp_replace(part, r"\A[A-Za-z][A-Za-z0-9]*;", "")
        decimal = F.regexp_extract(part, r"\A#([0-9]+)", 1)
        hexa = F.regexp_extract(part, r"\A#[xX]([0-9a-fA-F]+)", 1)
        after_number = F.regexp_replace(part, r"\A#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
        hex_code = F.when(F.length(F.ltrim(hexa, F.lit("0"))) <= 6, F.conv(hexa, 16, 10))
        return (
            F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substr(part, F.lit(5))))
            .when(
                part.rlike(r"\A#[0-9]"),
                F.concat(_numbered_character(decimal.try_cast("bigint")), after_number),
            )
            .when(
                part.rlike(r"\A#[xX][0-9a-fA-F]"),
                F.concat(_numbered_character(hex_code.try_cast("bigint")), after_number),
            )
            .when((name != "") & closed[name].isNotNull(), F.concat(closed[name], after_name))
            .when(
                prefix != "",
                F.concat(open_map[prefix], F.substr(part, F.length(prefix) + 1)),
            )
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&")
    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(parts[0], F.array_join(F.transform(tail, piece), ""))
