"""Results of parts of an archive that can be put together, and the sections from them.

A delivery is reduced to three small tables of its own.  Their rows add up: publications and
answers by sums and by first and last dates, runs by joining what touches.  Sections are read
off the merged tables; they cost what these hold, and a delivery costs its own size.  The
tables stand for puzzles, so each puzzle must be in one delivery only, with its entries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from periodica.functions.text import strip_hint
from periodica.operators import counts, streaks
from periodica.operators.common import attach, ordered

SETTER = "creator_name"
# The counted directions.
DIRECTIONS = ("across", "down")
_SUMS = ("n", *DIRECTIONS, "chars", "clues", "self_refs")


def publications(puzzles: DataFrame) -> DataFrame:
    """Puzzles by setter, kind and month: how many, and the first and last of their dates."""
    month = F.trunc("date", "month").alias("month")
    return puzzles.groupBy(SETTER, "crossword_type", month).agg(
        F.min("date").alias("date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n")
    )


def answers(puzzles: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries by setter and answer: how many, their directions, clue lengths and self-references."""
    rows = attach(entries.select("crossword_id", "solution", "clue", "direction"), puzzles, [SETTER])
    clue = F.col("clue")
    return rows.groupBy(SETTER, "solution").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("direction") == d).alias(d) for d in DIRECTIONS],
        F.coalesce(F.sum(F.when(clue != "", F.length(strip_hint(clue)))), F.lit(0)).alias("chars"),
        F.count_if(clue != "").alias("clues"),
        F.count_if(F.instr(clue, F.col(SETTER)) > 0).alias("self_refs"),
    )


def runs(puzzles: DataFrame) -> DataFrame:
    """The runs of each setter in every unit."""
    dated = puzzles.select(SETTER, "date").where("date is not null")
    each = [
        streaks.period_runs(dated, unit).select(
            F.lit(unit).alias("unit"),
            SETTER,
            *[F.col(c).cast("bigint").alias(c) for c in ("first_period", "last_period")],
            "streak_start",
            "streak_end",
            "streak_puzzles",
        )
        for unit in streaks.UNITS
    ]
    return reduce(DataFrame.unionByName, each)


# What a delivery of puzzles and entries is reduced to.
KINDS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "publications": lambda puzzles, entries: publications(puzzles),
    "answers": answers,
    "runs": lambda puzzles, entries: runs(puzzles),
}


def merged(kind: str, rows: DataFrame) -> DataFrame:
    """The rows of several deliveries as those of one that holds all their puzzles."""
    if kind == "publications":
        return rows.groupBy(SETTER, "crossword_type", "month").agg(
            F.min("date").alias("date"), F.max("last_date").alias("last_date"), F.sum("n").alias("n")
        )
    if kind == "answers":
        return rows.groupBy(SETTER, "solution").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return streaks.merged_runs(rows, "unit", SETTER)


def _per_setter(table: DataFrame, *columns: str) -> DataFrame:
    return table.groupBy(SETTER).agg(*[F.sum(c).alias(c) for c in columns])


def self_ref(table: DataFrame, sort: bool = True) -> DataFrame:
    found = _per_setter(table, "self_refs").where("self_refs > 0")
    return ordered(found.withColumnRenamed("self_refs", "n"), sort, SETTER)


def max_repeat(table: DataFrame) -> DataFrame:
    found = table.where("n > 1").groupBy(SETTER).agg(F.max("n").alias("max_count"))
    return found.orderBy(F.desc("max_count"), SETTER)


def top_answers(table: DataFrame, k: int = 50) -> DataFrame:
    found = table.where("solution <> ''").groupBy("solution").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "solution").limit(k)


def unique_ratio(table: DataFrame) -> DataFrame:
    found = table.where("solution <> ''").groupBy(SETTER).agg(
        F.count(F.lit(1)).alias("unique_solutions"), F.sum("n").alias("total_solutions")
    )
    ratio = F.round(F.lit(100.0) * F.col("unique_solutions") / F.col("total_solutions"), 1)
    return found.withColumn("ratio", ratio).orderBy(F.desc("ratio"), SETTER)


def avg_text_len(table: DataFrame) -> DataFrame:
    found = _per_setter(table, "chars", "clues").where("clues > 0")
    mean = F.round(F.col("chars") / F.col("clues"), 1).alias("avg_len")
    return found.select(SETTER, mean).orderBy(F.desc("avg_len"), SETTER)


def direction_balance(table: DataFrame) -> DataFrame:
    found = _per_setter(table, *DIRECTIONS)
    total = sum((F.col(d) for d in DIRECTIONS), F.lit(0))
    return found.where(total > 0).orderBy(total.desc(), SETTER)


def _streak(tables: Mapping[str, DataFrame], unit: str) -> DataFrame:
    return streaks.longest_of(tables["runs"].where(F.col("unit") == unit), unit)


def sections(tables: Mapping[str, DataFrame], last_year: int) -> dict[str, DataFrame]:
    """The sections, by name, as `plans.sections` gives them for all puzzles and entries.

    ``tables`` has the merged table of each kind.  Not here are the sections that list
    single puzzles (duplicates and document links): they have no smaller form.
    """
    made, said = tables["publications"], tables["answers"]
    return {
        "count_by_type": counts.count_by_type(made, weight="n"),
        "yearly_matrix": counts.yearly_matrix(made, last_year, weight="n"),
        "max_repeat": max_repeat(said),
        "bio_range": counts.bio_range(made, last="last_date"),
        "bio_totals": counts.bio_totals(made, self_ref(said, sort=False), weight="n"),
        "bio_yearly": counts.bio_yearly(made, weight="n"),
        "yearly_by_type": counts.yearly_by_type(made, weight="n"),
        "self_ref": self_ref(said),
        "top_answers": top_answers(said),
        "unique_ratio": unique_ratio(said),
        "avg_text_len": avg_text_len(said),
        "direction_balance": direction_balance(said),
        "debuts": counts.debuts(made, last_year),
        "debut_setters": counts.debut_setters(made),
        "month_season": counts.month_season(made, weight="n"),
        "week_streak": _streak(tables, "isoweek_code"),
        "week_streak_across_years": _streak(tables, "week"),
        "month_streak": _streak(tables, "month"),
    }
