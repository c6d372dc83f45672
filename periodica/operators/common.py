"""Shared pieces of the analytic operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def attach(
    entries: DataFrame,
    puzzles: DataFrame,
    columns: Sequence[str],
    entry_key: str = "crossword_id",
    puzzle_key: str = "id",
) -> DataFrame:
    """Inner join of item rows (or per-puzzle aggregates) with puzzle columns."""
    side = puzzles.select(F.col(puzzle_key).alias(entry_key), *columns)
    return entries.join(side, entry_key)


def count_of(weight: str | None, where: Column | None = None) -> Column:
    """How many rows there are (or fulfil a condition), or how many they stand for."""
    each = F.lit(1) if weight is None else F.col(weight)
    if where is not None:
        each = F.when(where, each).otherwise(0)
    return F.sum(each).cast("bigint")


def ordered(df: DataFrame, sort: bool, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys) if sort else df


def year_span(first: Column, last: Column) -> Column:
    """Contiguous years as an array; just the last one when ``first`` is later."""
    return F.sequence(F.least(F.coalesce(first, last), last), last)
