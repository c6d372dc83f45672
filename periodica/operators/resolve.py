"""Resolution of cross-references between items of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.functions.text import CROSS_REFERENCE, WS, full_match

_REFERENCE = {
    "prefix": rf"\ASee{WS}+[0-9]+",
    "full": rf"\ASee{WS}+[0-9]+\z",
}


def resolve_refs(
    entries: DataFrame,
    match: str = "prefix",
    puzzle_id: str = "crossword_id",
    entry_id: str = "entry_id",
    human_number: str = "human_number",
    direction: str = "direction",
    clue: str = "clue",
) -> DataFrame:
    """Give "See 5", "See 5 down" and the like the clue they point to.

    A reference looks up entries of the same puzzle by their whole displayed
    number, in the named direction if it names one.  Among several targets a
    real clue beats another reference, then the smaller direction wins.  One hop
    only; references without a target are dropped; other entries pass through.

    ``match="full"`` takes a clue for a reference only if nothing follows.

    Only entries whose number some reference of their puzzle names are looked at
    further, so no other text enters a shuffle.  These are reduced to the best
    one per number and direction before the join, so a reference meets one row
    at most however crowded a puzzle is.
    """
    text = F.col(clue)
    is_ref = F.coalesce(text.rlike(_REFERENCE[match]), F.lit(False))
    follow = "" if match == "prefix" else r"\z"
    named = F.when(text.rlike(rf"\ASee{WS}+[0-9]+{WS}+across{follow}"), "across").when(
        text.rlike(rf"\ASee{WS}+[0-9]+{WS}+down{follow}"), "down"
    )

    # min() over this struct: a real clue first, then direction, then entry.
    target = F.struct(
        (~F.coalesce(~full_match(text, CROSS_REFERENCE), F.lit(False))).alias("weak"),
        F.col(direction).isNull().alias("no_direction"),
        F.col(direction).alias("direction"),
        F.col(entry_id).alias("entry"),
        text.alias("clue"),
    )
    refs = entries.where(is_ref).select(
        "*",
        F.regexp_extract(text, rf"\ASee{WS}+([0-9]+)", 1).alias("_target"),
        named.alias("_named"),
    )
    wanted = refs.select(F.col(puzzle_id).alias("_puzzle"), F.col("_target").alias("_number")).distinct()
    aimed = entries.join(
        wanted,
        (F.col(puzzle_id) == F.col("_puzzle")) & (F.col(human_number) == F.col("_number")),
        "left_semi",
    )
    # Each entry takes part in one of the three, so no text travels twice, and
    # the grouping serves the join below.
    is_named = F.coalesce(F.col(direction).isin("across", "down"), F.lit(False))
    targets = aimed.groupBy(
        F.col(puzzle_id).alias("_puzzle"), F.col(human_number).alias("_number")
    ).agg(
        F.min(F.when(F.col(direction) == "across", target)).alias("_across"),
        F.min(F.when(F.col(direction) == "down", target)).alias("_down"),
        F.min(F.when(~is_named, target)).alias("_other"),
    )
    best = (
        F.when(F.col("_named") == "across", F.col("_across"))
        .when(F.col("_named") == "down", F.col("_down"))
        .otherwise(F.least("_across", "_down", "_other"))
    )
    found = (
        refs.join(
            targets,
            (refs[puzzle_id] == targets["_puzzle"]) & (refs["_target"] == targets["_number"]),
        )
        .withColumn("_best", best)
        .where(F.col("_best").isNotNull())
    )
    # One row per (puzzle, entry), also if the source repeats an entry.
    others = [c for c in entries.columns if c not in (puzzle_id, entry_id, clue)]
    chosen = found.groupBy(puzzle_id, entry_id).agg(
        F.min(
            F.struct("_best", F.coalesce(F.col("_best.clue"), text).alias(clue), *others)
        ).alias("_row")
    )
    resolved = chosen.select(
        *[
            F.col(c) if c in (puzzle_id, entry_id) else F.col(f"_row.{c}").alias(c)
            for c in entries.columns
        ]
    )
    return entries.where(~is_ref).unionByName(resolved)
