"""Search, sort and page over named result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from periodica.operators.resolve import resolve_refs
from periodica.operators.words import LINK_BASE, doc_links, dup_answers, dup_clues

DEFAULT_LENGTH = 10
LINE_BREAK = "<br />"


@dataclass(frozen=True)
class NamedTable:
    """A result table whose rows are groups of uses.

    ``rows`` gives the uses.  The table has a row for each value of ``keys``, and
    then a column for each of ``joined`` (column -> what is joined from the
    uses, in the order of ``order``).  Without ``joined`` the uses are the table.
    """

    rows: Callable[..., DataFrame]
    keys: tuple[str, ...]
    searchable: tuple[str, ...]
    joined: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *(name for name, _ in self.joined))


def answer_uses(
    entries: DataFrame, puzzles: DataFrame, link_base: str = LINK_BASE
) -> DataFrame:
    return dup_answers(resolve_refs(entries), puzzles, link_base=link_base, sort=False)


def clue_uses(entries: DataFrame, puzzles: DataFrame, link_base: str = LINK_BASE) -> DataFrame:
    return dup_clues(resolve_refs(entries), puzzles, link_base=link_base, sort=False)


def table_doc_links(entries: DataFrame | None, puzzles: DataFrame) -> DataFrame:
    """Setter, link and date text of the puzzles with a document."""
    return doc_links(puzzles, sort=False)


TABLES: Mapping[str, NamedTable] = {
    "dup_answers": NamedTable(
        answer_uses,
        keys=("creator_name", "solution"),
        joined=(("clues", "clue"), ("types", "crossword_type"), ("links", "link")),
        order=("number", "crossword_id", "clue"),
        searchable=("creator_name", "solution", "clue"),
    ),
    "dup_clues": NamedTable(
        clue_uses,
        keys=("creator_name", "clue"),
        joined=(("types", "crossword_type"), ("links", "link")),
        order=("number", "crossword_id"),
        searchable=("creator_name", "clue"),
    ),
    "doc_links": NamedTable(
        table_doc_links,
        keys=("creator_name", "link", "date_text"),
        searchable=("creator_name", "link", "date_text"),
    ),
}


def named_table(name: str) -> NamedTable:
    try:
        return TABLES[name]
    except KeyError:
        raise ValueError(f"unknown table: {name!r}") from None


def search_pattern(search: str, literal: bool = False) -> tuple[str, str]:
    """The pattern that a text containing the search is like, and its escape character.

    ``%`` and ``_`` in the search act as wildcards unless ``literal``; the escape
    character is one the search does not contain, so a backslash is just itself.
    """
    escape = next(c for c in map(chr, range(1, 0x10000)) if c not in search and c not in "%_")
    if literal:
        for wildcard in "%_":
            search = search.replace(wildcard, escape + wildcard)
    return f"%{search}%", escape


def _contains(column: str, search: str, literal: bool) -> Column:
    """Case-insensitive substring test, see :func:`search_pattern`."""
    pattern, escape = search_pattern(search, literal)
    return F.ilike(F.col(column).cast("string"), F.lit(pattern), F.lit(escape))


def search_condition(search: str, columns: Sequence[str], literal: bool = False) -> Column:
    return reduce(or_, [_contains(c, search, literal) for c in columns])


def table_search(
    table: DataFrame, search: str, columns: Sequence[str], literal: bool = False
) -> DataFrame:
    """Rows in which any of the columns contains the search; all rows if it is empty."""
    return table.where(search_condition(search, columns, literal)) if search else table


def column_search(
    table: DataFrame, searches: Mapping[str, str], literal: bool = False
) -> DataFrame:
    """Rows in which every named column contains its own search."""
    tests = [_contains(c, s, literal) for c, s in searches.items() if s]
    return table.where(reduce(and_, tests)) if tests else table


def sort_keys(
    table: DataFrame, column: int | None, direction: str = "asc"
) -> list[Column]:
    """Sort by a column's ordinal, NULLs last, then by the whole row.

    An ordinal outside the table is ignored; any direction but "desc" (in any
    case) means ascending.
    """
    keys = []
    if column is not None and 0 <= column < len(table.columns):
        chosen = F.col(table.columns[column])
        keys = [
            chosen.desc_nulls_last() if direction.lower() == "desc" else chosen.asc_nulls_last()
        ]
    return keys + [F.col(c).asc_nulls_last() for c in table.columns]


def table_sort(table: DataFrame, column: int | None = None, direction: str = "asc") -> DataFrame:
    return table.orderBy(*sort_keys(table, column, direction))


def table_page(
    table: DataFrame,
    column: int | None = None,
    direction: str = "asc",
    start: int = 0,
    length: int = DEFAULT_LENGTH,
) -> DataFrame:
    """One page of the sorted table; a length below 1 means the default length.

    Each task keeps only its first ``start + length`` rows.  For pages far into
    a large table use :func:`page_after`, whose cost does not grow with depth.
    """
    if start < 0:
        raise ValueError("start must not be negative")
    length = length if length > 0 else DEFAULT_LENGTH
    return table_sort(table, column, direction).offset(start).limit(length)


def page_after(
    table: DataFrame,
    last_row: Mapping[str, object],
    column: int | None = None,
    direction: str = "asc",
    length: int = DEFAULT_LENGTH,
) -> DataFrame:
    """The page that follows ``last_row`` in the order of :func:`table_sort`."""
    length = length if length > 0 else DEFAULT_LENGTH
    order = list(table.columns)
    falling = set()
    if column is not None and 0 <= column < len(order):
        first = order.pop(column)
        order.insert(0, first)
        if direction.lower() == "desc":
            falling = {first}
    later, same = F.lit(False), F.lit(True)
    for name in order:
        value = F.lit(last_row[name])
        here = F.col(name)
        if last_row[name] is None:
            beyond = F.lit(False)
        else:
            beyond = (here < value if name in falling else here > value) | here.isNull()
        later = later | (same & F.coalesce(beyond, F.lit(False)))
        same = same & here.eqNullSafe(value)
    return table_sort(table.where(later), column, direction).limit(length)


def _kept(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def table_groups(
    spec: NamedTable, rows: DataFrame, conditions: Sequence[Column] = ()
) -> DataFrame:
    """The rows of a named table: its keys, ``n_uses`` and the first of what is joined.

    A group is kept if each condition holds for some use of it.  Uses are reduced
    in the tasks before the shuffle; no list is built.
    """
    if not spec.joined:
        return rows.where(reduce(and_, map(_kept, conditions), F.lit(True)))
    order = F.struct(*spec.order)
    found = rows.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_uses"),
        F.min_by(F.struct(*[F.col(use).alias(name) for name, use in spec.joined]), order).alias("_first"),
        *[F.max(_kept(c)).alias(f"_{i}") for i, c in enumerate(conditions)],
    )
    for i in range(len(conditions)):
        found = found.where(F.col(f"_{i}"))
    return found.select(*spec.keys, "_first.*", "n_uses")


def page_texts(spec: NamedTable, rows: DataFrame, page: DataFrame) -> DataFrame:
    """The groups of a page, one row each, with all their uses joined into texts.

    ``page`` holds the few groups of a page, which is what bounds the broadcast;
    the uses of other groups are never collected.
    """
    if not spec.joined:
        return page
    same = [rows[k].eqNullSafe(page[k]) for k in spec.keys]
    used = rows.join(F.broadcast(page.select(*spec.keys)), reduce(and_, same), "left_semi")
    picked = dict.fromkeys([*spec.order, *(use for _, use in spec.joined)])
    uses = F.array_sort(F.collect_list(F.struct(*picked)))
    lists = used.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_uses"), uses.alias("_uses"))

    def text(use: str) -> Column:
        return F.array_join(F.transform("_uses", lambda u: u[use].cast("string")), LINE_BREAK)

    return lists.select(*spec.keys, *[text(use).alias(name) for name, use in spec.joined], "n_uses")


@dataclass(frozen=True)
class TablePage:
    draw: int
    records_total: int
    records_filtered: int
    data: DataFrame


def table_counts(
    spec: NamedTable, rows: DataFrame, search: str = "", literal: bool = False
) -> DataFrame:
    """One row: all rows of a named table, and those the search keeps, from a single pass."""
    kept = _kept(search_condition(search, spec.searchable, literal) if search else None)
    if spec.joined:
        rows = rows.groupBy(*spec.keys).agg(F.max(kept).alias("_kept"))
        kept = F.col("_kept")
    return rows.agg(
        F.count(F.lit(1)).alias("records_total"), F.count_if(kept).alias("records_filtered")
    )


def stored_rows(rows: DataFrame, path: str) -> DataFrame:
    """The uses behind a named table, written once, for any number of requests."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def result_page(
    spec: NamedTable,
    rows: DataFrame,
    draw: int = 0,
    search: str = "",
    column: int | None = None,
    direction: str = "asc",
    start: int = 0,
    length: int = DEFAULT_LENGTH,
    literal: bool = False,
) -> TablePage:
    """Counts and one page of text rows of a named table.

    ``rows`` are its stored uses, see :func:`stored_rows`.  A search looks at each
    use by itself.  The page is cut on the keys and, for a sort by a joined
    column, on the group's first use; texts are joined for its groups only.  A
    page row holding a NULL is left out, though it is part of the counts.
    """
    counts = table_counts(spec, rows, search, literal).first()
    conditions = [search_condition(search, spec.searchable, literal)] if search else []
    found = table_groups(spec, rows, conditions).select(*spec.columns)
    page = table_page(found, column, direction, start, length)
    texts = table_sort(page_texts(spec, rows, page).select(*spec.columns), column, direction)
    shown = texts.select(*[F.col(c).cast("string").alias(c) for c in spec.columns]).dropna()
    return TablePage(draw, counts["records_total"], counts["records_filtered"], shown)


def table_request(
    name: str, entries: DataFrame | None, puzzles: DataFrame, path: str, **request: object
) -> TablePage:
    """A page of a table chosen by name, whose uses are stored at ``path`` first.

    Unknown names raise ``ValueError``.  For further pages of the same table call
    :func:`result_page` with the stored uses.
    """
    spec = named_table(name)
    return result_page(spec, stored_rows(spec.rows(entries, puzzles), path), **request)
