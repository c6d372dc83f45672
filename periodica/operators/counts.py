"""One-pass counts by setter, type, date part and direction.

Where a `weight` is named, a row stands for so many puzzles of its setter, kind and month,
as the rows of `operators.partials.publications` do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from periodica.functions.dates import inclusive_duration
from periodica.operators.common import attach, count_of, ordered, year_span

# Month labels.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def count_by_type(
    puzzles: DataFrame,
    setter: str = "creator_name",
    kind: str = "crossword_type",
    kinds: Sequence[str] = ("cryptic", "prize"),
    sort: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Puzzles per setter with one column per kind.

    Order: a setter stands where its first kind stands among all (setter, kind)
    groups by count descending, kind and name; where that kind is missing, the
    next one counts.  Setters with none of the kinds come first.  The place is
    expressed as a sort key per setter, which needs no global numbering.
    """
    counts = [count_of(weight, F.col(kind) == k).alias(k) for k in kinds]
    table = puzzles.groupBy(setter).agg(*counts)
    if not sort:
        return table
    place_count, place_kind = F.lit(None), F.lit(None)
    for k in reversed(kinds):
        place_count = F.when(F.col(k) > 0, F.col(k)).otherwise(place_count)
        place_kind = F.when(F.col(k) > 0, F.lit(k)).otherwise(place_kind)
    return table.orderBy(
        place_count.desc_nulls_first(), place_kind.asc_nulls_first(), F.col(setter).asc()
    )


def yearly_matrix(
    puzzles: DataFrame,
    last_year: int,
    first_year: int = 1998,
    setter: str = "creator_name",
    date: str = "date",
    sort: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Puzzles per setter and year, zero-filled from ``first_year`` to ``last_year``.

    The counts of a setter travel as one small map (a key per year), from which
    the dense years are read; no spine join is needed.
    """
    year = F.year(date)
    per_year = puzzles.groupBy(setter, year.alias("year")).agg(count_of(weight).alias("n"))
    in_span = F.when(
        F.col("year").between(first_year, last_year), F.struct("year", "n")
    )
    dense = (
        per_year.groupBy(setter)
        .agg(F.map_from_entries(F.collect_list(in_span)).alias("_by_year"))
        .withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
        .select(setter, "year", F.coalesce(F.col("_by_year")[F.col("year")], F.lit(0)).alias("n"))
    )
    return ordered(dense, sort, setter, "year")


def bio_range(
    puzzles: DataFrame,
    setter: str = "creator_name",
    date: str = "date",
    sort: bool = True,
    last: str | None = None,
) -> DataFrame:
    """First date, last date and the inclusive duration between them, per setter.

    ``last`` names the column of the last date of what a row stands for.
    """
    spans = puzzles.groupBy(setter).agg(
        F.min(date).alias("first_date"), F.max(last or date).alias("last_date")
    )
    table = spans.withColumn(
        "duration", inclusive_duration(F.col("first_date"), F.col("last_date"))
    )
    return ordered(table, sort, setter)


def yearly_by_type(
    puzzles: DataFrame,
    setter: str = "creator_name",
    date: str = "date",
    kind: str = "crossword_type",
    sort: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Count per setter, year and kind, and its monthly average rounded up."""
    table = (
        puzzles.groupBy(setter, F.year(date).alias("year"), kind)
        .agg(count_of(weight).alias("n"))
        .withColumn("per_month", F.ceil(F.col("n") / 12).cast("int"))
    )
    return ordered(table, sort, setter, "year", kind)


def bio_yearly(
    puzzles: DataFrame,
    setter: str = "creator_name",
    date: str = "date",
    sort: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Count per setter and year over all kinds; years without puzzles are absent."""
    table = (
        puzzles.groupBy(setter, F.year(date).alias("year"))
        .agg(count_of(weight).alias("n"))
        .withColumn("per_month", F.ceil(F.col("n") / 12).cast("int"))
    )
    return ordered(table, sort, setter, "year")


def bio_totals(
    puzzles: DataFrame,
    self_refs: DataFrame,
    setter: str = "creator_name",
    kind: str = "crossword_type",
    kinds: Sequence[str] = ("cryptic", "prize"),
    sort: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Total, totals of the named kinds, and self-references (0 if none) per setter.

    ``self_refs`` is the result of :func:`periodica.operators.words.self_ref`.
    """
    totals = puzzles.groupBy(setter).agg(
        count_of(weight).alias("total"),
        *[count_of(weight, F.col(kind) == k).alias(f"total_{k}") for k in kinds],
    )
    table = totals.join(
        self_refs.select(setter, F.col("n").alias("self_refs")), setter, "left"
    ).withColumn("self_refs", F.coalesce("self_refs", F.lit(0)))
    return ordered(table, sort, setter)


def direction_balance(
    entries: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    direction: str = "direction",
    directions: Sequence[str] = ("across", "down"),
    entry_key: str = "crossword_id",
    sort: bool = True,
) -> DataFrame:
    """Entries per setter in each direction, busiest setter first.

    Entries are counted per puzzle before the join, which then carries one row
    per puzzle and is safe against a puzzle with very many entries.
    """
    per_puzzle = (
        entries.where(F.col(direction).isin(*directions))
        .groupBy(entry_key)
        .agg(*[F.count_if(F.col(direction) == d).alias(d) for d in directions])
    )
    table = (
        attach(per_puzzle, puzzles, [setter], entry_key)
        .groupBy(setter)
        .agg(*[F.sum(d).alias(d) for d in directions])
    )
    total = sum((F.col(d) for d in directions), F.lit(0))
    return ordered(table, sort, total.desc(), setter)


def debut_setters(
    puzzles: DataFrame, setter: str = "creator_name", date: str = "date", sort: bool = True
) -> DataFrame:
    """Every setter with the year in which they published for the first time."""
    table = puzzles.groupBy(setter).agg(F.year(F.min(date)).alias("year")).select("year", setter)
    return ordered(table, sort, "year", setter)


def debuts(
    puzzles: DataFrame,
    last_year: int,
    setter: str = "creator_name",
    date: str = "date",
    sort: bool = True,
) -> DataFrame:
    """Per year, how many setters published for the first time.

    Years are contiguous from the earliest debut to ``last_year``; a year
    without debuts has count 0.  :func:`debut_setters` tells who they are.
    """
    per_year = (
        debut_setters(puzzles, setter, date, sort=False)
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n_setters"))
    )
    # The counts travel as one small map (a key per year) beside the years.
    known = F.when(F.col("year").isNotNull(), F.struct("year", "n_setters"))
    table = (
        per_year.agg(
            F.min("year").alias("_first"),
            F.map_from_entries(F.collect_list(known)).alias("_by_year"),
        )
        .withColumn("year", F.explode(year_span(F.col("_first"), F.lit(last_year))))
        .select("year", F.coalesce(F.col("_by_year")[F.col("year")], F.lit(0)).alias("n_setters"))
    )
    return ordered(table, sort, "year")


def month_season(
    puzzles: DataFrame, date: str = "date", sort: bool = True, weight: str | None = None
) -> DataFrame:
    """Puzzles per calendar month; always twelve rows."""
    counts = puzzles.groupBy(F.month(date).alias("month")).agg(count_of(weight).alias("n"))
    months = puzzles.sparkSession.range(1, 13, numPartitions=1).select(
        F.col("id").cast("int").alias("month")
    )
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    table = months.join(counts, "month", "left").select(
        "month",
        F.element_at(names, F.col("month")).alias("month_name"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    return ordered(table, sort, "month")
