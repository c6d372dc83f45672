"""Operators over answers and clue texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.text import anchor, is_placeholder, strip_hint
from periodica.operators.common import attach, ordered

LINK_BASE = "https://archive.example/"
SKETCH_LOG_SIZE = 14


def max_repeat(
    entries: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    solution: str = "solution",
    entry_key: str = "crossword_id",
    sort: bool = True,
) -> DataFrame:
    """The most often any one answer (blank included) recurs, per setter.

    Setters who never repeat an answer are absent.
    """
    table = (
        attach(entries.select(entry_key, solution), puzzles, [setter], entry_key)
        .groupBy(setter, solution)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .groupBy(setter)
        .agg(F.max("n").alias("max_count"))
    )
    return ordered(table, sort, F.desc("max_count"), setter)


def self_ref(
    entries: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    clue: str = "clue",
    entry_key: str = "crossword_id",
    sort: bool = True,
) -> DataFrame:
    """Entries per setter whose clue contains the setter's name."""
    table = (
        attach(entries.select(entry_key, clue), puzzles, [setter], entry_key)
        .where(F.instr(F.col(clue), F.col(setter)) > 0)
        .groupBy(setter)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ordered(table, sort, setter)


def _real_uses(
    resolved: DataFrame,
    puzzles: DataFrame,
    item_columns: list[str],
    setter: str,
    kind: str,
    number: str,
    clue: str,
    entry_key: str,
) -> DataFrame:
    """Distinct uses of real clues, with the puzzle's setter, kind and number.

    The distinct runs before the join: the puzzle columns depend on the puzzle
    id alone, and the wide key spreads a puzzle with very many entries.
    """
    uses = resolved.where(~is_placeholder(F.col(clue))).select(entry_key, *item_columns).distinct()
    return attach(uses, puzzles, [setter, kind, number], entry_key)


def _duplicates(
    resolved: DataFrame,
    puzzles: DataFrame,
    shared: str,
    setter: str,
    kind: str,
    number: str,
    clue: str,
    entry_key: str,
    link_base: str,
    sort: bool,
) -> DataFrame:
    item_columns = list(dict.fromkeys([shared, clue]))
    uses = _real_uses(resolved, puzzles, item_columns, setter, kind, number, clue, entry_key)
    # Counted in the tasks before the shuffle, so a large group is one row there.
    groups = (
        uses.groupBy(F.col(setter).alias("_setter"), F.col(shared).alias("_shared"))
        .agg(
            F.count(F.lit(1)).alias("n_uses"),
            F.min(entry_key).alias("_first"),
            F.max(entry_key).alias("_last"),
        )
        .where(F.col("_first") != F.col("_last"))
    )
    same = F.col(setter).eqNullSafe(F.col("_setter")) & F.col(shared).eqNullSafe(F.col("_shared"))
    others = [c for c in item_columns if c != shared]
    table = uses.join(groups, same).select(
        setter,
        shared,
        "n_uses",
        number,
        entry_key,
        *others,
        kind,
        anchor(F.concat(F.lit(link_base), F.col(entry_key)), F.col(number)).alias("link"),
    )
    return ordered(table, sort, setter, shared, number, entry_key, *others)


def dup_answers(
    resolved: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    solution: str = "solution",
    kind: str = "crossword_type",
    number: str = "number",
    clue: str = "clue",
    entry_key: str = "crossword_id",
    link_base: str = LINK_BASE,
    sort: bool = True,
) -> DataFrame:
    """The uses of the answers that one setter used in more than one puzzle.

    One row per use, with the number of uses of its group; the puzzle number
    compares as text.  ``resolved`` is the result of ``resolve_refs``.  The form
    is the same whatever the size of a group; ``tables.page_texts`` joins the
    uses of the groups of a page.
    """
    return _duplicates(
        resolved.select(entry_key, solution, clue), puzzles, solution,
        setter, kind, number, clue, entry_key, link_base, sort,
    )


def dup_clues(
    resolved: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    kind: str = "crossword_type",
    number: str = "number",
    clue: str = "clue",
    entry_key: str = "crossword_id",
    link_base: str = LINK_BASE,
    sort: bool = True,
) -> DataFrame:
    """The uses of the clues that one setter used in more than one puzzle."""
    return _duplicates(
        resolved.select(entry_key, clue), puzzles, clue,
        setter, kind, number, clue, entry_key, link_base, sort,
    )


def doc_links(
    puzzles: DataFrame,
    setter: str = "creator_name",
    number: str = "number",
    pdf: str = "pdf",
    date: str = "date",
    sort: bool = True,
) -> DataFrame:
    """Setter, link and date text of every puzzle that has a document."""
    table = puzzles.where(F.col(pdf).isNotNull())
    table = ordered(table, sort, setter, number)
    return table.select(
        setter,
        anchor(F.col(pdf), F.col(number)).alias("link"),
        F.col(date).cast("string").alias("date_text"),
    )


def top_answers(entries: DataFrame, solution: str = "solution", k: int = 50) -> DataFrame:
    """The ``k`` most frequent answers; blanks do not count, ties go by answer."""
    return (
        entries.where(F.col(solution) != "")
        .groupBy(solution)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), solution)
        .limit(k)
    )


def answer_sketches(
    entries: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    solution: str = "solution",
    entry_key: str = "crossword_id",
    date: str = "date",
    log_size: int = SKETCH_LOG_SIZE,
) -> DataFrame:
    """A sketch of the distinct answers of each setter and year, and how many answers there are.

    Sketches of any deliveries and years unite to that of them all, so they can be stored;
    each has at most 2^log_size bytes, whatever it has seen.
    """
    answered = entries.where(F.col(solution) != "").select(entry_key, solution)
    return (
        attach(answered, puzzles, [setter, date], entry_key)
        .groupBy(setter, F.year(date).alias("year"))
        .agg(
            F.hll_sketch_agg(solution, log_size).alias("sketch"),
            F.count(F.lit(1)).alias("total_solutions"),
        )
    )


def ratio_of_sketches(
    sketches: DataFrame, setter: str = "creator_name", sort: bool = True
) -> DataFrame:
    """Estimated distinct answers as a percentage of all answers, per setter."""
    table = sketches.groupBy(setter).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_solutions"),
        F.sum("total_solutions").alias("total_solutions"),
    )
    # An estimate may exceed what there is.
    table = table.withColumn("unique_solutions", F.least("unique_solutions", "total_solutions"))
    return ordered(table.withColumn("ratio", _ratio()), sort, F.desc("ratio"), setter)


def _ratio() -> Column:
    return F.round(F.lit(100.0) * F.col("unique_solutions") / F.col("total_solutions"), 1)


def unique_ratio(
    entries: DataFrame,
    puzzles: DataFrame,
    setter: str = "creator_name",
    solution: str = "solution",
    entry_key: str = "crossword_id",
    sort: bool = True,
    approx: bool = False,
    date: str = "date",
) -> DataFrame:
    """Distinct answers as a percentage of all answers, per setter.

    With ``approx`` the distinct answers are estimated from sketches: no row per answer is
    shuffled.  The standard error is 1.04 / 2^(log_size / 2), 0.8 % here; small counts are exact.
    """
    if approx:
        sketches = answer_sketches(entries, puzzles, setter, solution, entry_key, date)
        return ratio_of_sketches(sketches, setter, sort)
    answered = entries.where(F.col(solution) != "").select(entry_key, solution)
    table = (
        attach(answered, puzzles, [setter], entry_key)
        .groupBy(setter, solution)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(setter)
        .agg(
            F.count(F.lit(1)).alias("unique_solutions"),
            F.sum("n").alias("total_solutions"),
        )
        .withColumn("ratio", _ratio())
    )
    return ordered(table, sort, F.desc("ratio"), setter)


def avg_text_len(
    entries: DataFrame,
    puzzles: DataFrame | None = None,
    setter: str = "creator_name",
    clue: str = "clue",
    entry_key: str = "crossword_id",
    sort: bool = True,
) -> DataFrame:
    """Mean clue length in characters without the length hint, per setter.

    Lengths are summed per puzzle before the join, so clue texts are never
    shuffled.  Without ``puzzles`` the setter is a column of ``entries``.
    """
    length = F.length(strip_hint(F.col(clue)))
    sums = [F.sum(length).alias("_chars"), F.count(F.lit(1)).alias("_n")]
    texts = entries.where(F.col(clue) != "")
    if puzzles is None:
        per_setter = texts.groupBy(setter).agg(*sums)
    else:
        per_puzzle = texts.groupBy(entry_key).agg(*sums)
        per_setter = (
            attach(per_puzzle, puzzles, [setter], entry_key)
            .groupBy(setter)
            .agg(F.sum("_chars").alias("_chars"), F.sum("_n").alias("_n"))
        )
    table = per_setter.select(setter, F.round(F.col("_chars") / F.col("_n"), 1).alias("avg_len"))
    return ordered(table, sort, F.desc("avg_len"), setter)
