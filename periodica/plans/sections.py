"""The catalogue of analytic sections, in their order of presentation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from periodica.operators import counts, streaks, words
from periodica.operators.resolve import resolve_refs


@dataclass(frozen=True)
class Archive:
    """The two stored tables, and the year that counts as the current one."""

    puzzles: DataFrame
    entries: DataFrame
    last_year: int

    @cached_property
    def resolved(self) -> DataFrame:
        return resolve_refs(self.entries)


@dataclass(frozen=True)
class Section:
    order: str
    name: str
    build: Callable[[Archive], DataFrame]


_SECTIONS: dict[str, Section] = {}


def register(order: str, name: str, build: Callable[[Archive], DataFrame]) -> Section:
    """Add a section; ``order`` is its place, such as "5" or "5a"."""
    if name in _SECTIONS:
        raise ValueError(f"section {name!r} exists")
    _SECTIONS[name] = Section(order, name, build)
    return _SECTIONS[name]


def place(order: str) -> tuple[int, str]:
    """Sort key by the leading number, so that "2" < "5" < "5a" < "10"."""
    digits = re.match(r"[0-9]*", order).group()
    return int(digits or 0), order


def sections() -> list[Section]:
    return sorted(_SECTIONS.values(), key=lambda s: place(s.order))


def section(name: str) -> Section:
    try:
        return _SECTIONS[name]
    except KeyError:
        raise ValueError(f"unknown section: {name!r}") from None


def render(archive: Archive) -> dict[str, DataFrame]:
    """All sections in order; each value is a DataFrame still to be run."""
    return {s.name: s.build(archive) for s in sections()}


register("1", "count_by_type", lambda a: counts.count_by_type(a.puzzles))
register("2", "yearly_matrix", lambda a: counts.yearly_matrix(a.puzzles, a.last_year))
register("3", "max_repeat", lambda a: words.max_repeat(a.entries, a.puzzles))
register("4", "bio_range", lambda a: counts.bio_range(a.puzzles))
register(
    "4",
    "bio_totals",
    lambda a: counts.bio_totals(a.puzzles, words.self_ref(a.entries, a.puzzles, sort=False)),
)
register("4", "bio_yearly", lambda a: counts.bio_yearly(a.puzzles))
register("4", "yearly_by_type", lambda a: counts.yearly_by_type(a.puzzles))
register("5", "dup_answers", lambda a: words.dup_answers(a.resolved, a.puzzles))
register("5a", "dup_clues", lambda a: words.dup_clues(a.resolved, a.puzzles))
register("6", "doc_links", lambda a: words.doc_links(a.puzzles))
register("7", "top_answers", lambda a: words.top_answers(a.entries))
register("8", "unique_ratio", lambda a: words.unique_ratio(a.entries, a.puzzles))
register("9", "avg_text_len", lambda a: words.avg_text_len(a.entries, a.puzzles))
register("10", "direction_balance", lambda a: counts.direction_balance(a.entries, a.puzzles))
register("11", "debuts", lambda a: counts.debuts(a.puzzles, a.last_year))
register("11", "debut_setters", lambda a: counts.debut_setters(a.puzzles))
register("12", "month_season", lambda a: counts.month_season(a.puzzles))
register("13", "week_streak", lambda a: streaks.week_streak(a.puzzles))
register("14", "month_streak", lambda a: streaks.month_streak(a.puzzles))
