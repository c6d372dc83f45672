"""Runs of consecutive weeks or months in which a setter published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from periodica.functions.dates import isoweek_code, month_ordinal, week_ordinal
from periodica.operators.common import ordered

# isoweek_code breaks every run at the turn of the ISO year; week does not.
UNITS = {"isoweek_code": isoweek_code, "week": week_ordinal, "month": month_ordinal}


def period_runs(
    puzzles: DataFrame, unit: str, setter: str = "creator_name", date: str = "date"
) -> DataFrame:
    """All runs per setter: first and last period, first dates in these, puzzles.

    Rows are reduced to one per setter and period before anything is ordered, so a
    setter's group is bounded by the calendar.  Runs of parts of the puzzles are put
    together by :func:`merged_runs`.
    """
    periods = puzzles.groupBy(setter, UNITS[unit](F.col(date)).alias("_period")).agg(
        F.min(date).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    place = F.row_number().over(Window.partitionBy(setter).orderBy("_period"))
    return (
        periods.withColumn("_island", F.col("_period") - place)
        .groupBy(setter, "_island")
        .agg(
            F.min("_period").alias("first_period"),
            F.max("_period").alias("last_period"),
            F.min("_first").alias("streak_start"),
            F.max("_first").alias("streak_end"),
            F.sum("_n").alias("streak_puzzles"),
        )
        .drop("_island")
    )


def merged_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs of several parts put together: what overlaps or touches becomes one run.

    ``keys`` are the setter's column and others that runs are kept apart by; without
    them, ``creator_name``.  Merging is associative and the order of the parts makes no
    difference, so parts may be merged in any order and as often as they come; late dates
    may split no run, but close gaps between others.  Only runs are ordered, not periods.
    """
    keys = keys or ("creator_name",)
    own = Window.partitionBy(*keys).orderBy("first_period", "last_period")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("first_period") > F.max("last_period").over(before) + 1
    # A run that begins or ends the merged one with others has the first of their dates.
    ends = F.struct("last_period", F.datediff(F.lit("1970-01-01").cast("date"), "streak_end"), "streak_end")
    begins = F.struct("first_period", "streak_start")
    return (
        runs.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_opens").over(own))
        .groupBy(*keys, "_island")
        .agg(
            F.min("first_period").alias("first_period"),
            F.max("last_period").alias("last_period"),
            F.min(begins)["streak_start"].alias("streak_start"),
            F.max(ends)["streak_end"].alias("streak_end"),
            F.sum("streak_puzzles").alias("streak_puzzles"),
        )
        .drop("_island")
    )


def streaks(
    puzzles: DataFrame, unit: str, setter: str = "creator_name", date: str = "date"
) -> DataFrame:
    """All runs per setter: length, first and last publication date, puzzles.

    ``streak_start`` and ``streak_end`` are the first dates published on in the
    first and in the last period.
    """
    return _measured(period_runs(puzzles, unit, setter, date))


def _measured(runs: DataFrame) -> DataFrame:
    length = (F.col("last_period") - F.col("first_period") + 1).cast("bigint")
    return runs.withColumn("streak_length", length).drop("first_period", "last_period")


def longest_streak(
    puzzles: DataFrame,
    unit: str,
    setter: str = "creator_name",
    date: str = "date",
    sort: bool = True,
) -> DataFrame:
    """The longest run of each setter; of equally long ones the earliest."""
    return longest_of(period_runs(puzzles, unit, setter, date), unit, setter, sort)


def longest_of(
    runs: DataFrame, unit: str, setter: str = "creator_name", sort: bool = True
) -> DataFrame:
    """The longest of each setter's runs, of :func:`period_runs` or :func:`merged_runs`."""
    runs = _measured(runs)
    best = F.min(
        F.struct(
            (-F.col("streak_length")).alias("rank"),
            "streak_start",
            "streak_end",
            "streak_puzzles",
        )
    )
    table = (
        runs.groupBy(setter)
        .agg(best.alias("_best"))
        .select(
            setter,
            (-F.col("_best.rank")).alias("streak_length"),
            "_best.streak_start",
            "_best.streak_end",
            "_best.streak_puzzles",
        )
    )
    if unit == "month":
        for c in ("streak_start", "streak_end"):
            table = table.withColumn(c, F.date_format(c, "yyyy-MM"))
    return ordered(table, sort, F.desc("streak_length"), setter)


def week_streak(puzzles: DataFrame, unit: str = "isoweek_code", **kw) -> DataFrame:
    """Longest run of consecutive ISO weeks per setter."""
    return longest_streak(puzzles, unit, **kw)


def month_streak(puzzles: DataFrame, **kw) -> DataFrame:
    """Longest run of consecutive calendar months per setter, as ``YYYY-MM``."""
    return longest_streak(puzzles, "month", **kw)
