"""Layout fingerprints of puzzles and their match with a grid catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LAYOUT = ["n_rows", "n_cols", "fingerprint"]


def fingerprint_text(cells: Column) -> Column:
    """Sorted white-cell numbers as one comma-separated text."""
    return F.array_join(F.array_sort(cells), ",")


def grid_fingerprint(
    entries: DataFrame,
    n_rows: int | str = 15,
    n_cols: int | str = 15,
    puzzle_id: str = "crossword_id",
    direction: str = "direction",
    length: str = "length",
    pos_x: str = "pos_x",
    pos_y: str = "pos_y",
) -> DataFrame:
    """White cells of each puzzle, read off the cells its entries cover.

    ``n_rows`` and ``n_cols`` are numbers or columns of ``entries``.  The cells
    of a puzzle are a set of numbers below rows x cols, so a puzzle's group stays
    that small however often its entries repeat; tasks reduce them before the
    shuffle.  A puzzle with a cell outside its grid has no fingerprint.
    """
    rows = F.col(n_rows) if isinstance(n_rows, str) else F.lit(n_rows)
    cols = F.col(n_cols) if isinstance(n_cols, str) else F.lit(n_cols)
    across = F.col(direction) == "across"
    step = F.when(across, F.lit(1)).otherwise(cols)
    start = F.col(pos_y) * cols + F.col(pos_x)
    last_x = F.col(pos_x) + F.when(across, F.col(length) - 1).otherwise(0)
    last_y = F.col(pos_y) + F.when(across, 0).otherwise(F.col(length) - 1)
    inside = (
        (F.col(pos_x) >= 0) & (F.col(pos_y) >= 0) & (last_x < cols) & (last_y < rows)
    )
    cells = F.when(
        inside, F.transform(F.sequence(F.lit(0), F.col(length) - 1), lambda i: start + i * step)
    ).otherwise(F.array(F.lit(-1)))
    covered = entries.where(F.col(length) > 0).select(
        F.col(puzzle_id),
        rows.cast("int").alias("n_rows"),
        cols.cast("int").alias("n_cols"),
        F.explode(cells).alias("_cell"),
    )
    return (
        covered.groupBy(puzzle_id, "n_rows", "n_cols")
        .agg(F.collect_set("_cell").alias("_cells"))
        .select(
            puzzle_id,
            "n_rows",
            "n_cols",
            F.when(~F.array_contains("_cells", -1), fingerprint_text(F.col("_cells"))).alias(
                "fingerprint"
            ),
        )
    )


def blanks_fingerprint(lists: Column, n_rows: int = 15, n_cols: int = 15) -> Column:
    """White cells from one text of blank-cell letters per grid row, e.g. "A C E".

    Letters count columns from A in either case.  Rows without a text are white;
    a letter outside the grid gives NULL.
    """
    def black(text: Column, row: Column) -> Column:
        letters = F.filter(F.split(text, " "), lambda c: c != "")
        place = lambda c: F.ascii(F.upper(c)) - F.ascii(F.lit("A"))
        return F.transform(
            letters,
            lambda c: F.when(
                (row < n_rows) & place(c).between(0, n_cols - 1), row * n_cols + place(c)
            ).otherwise(-1),
        )

    blacks = F.flatten(F.transform(lists, black))
    whites = F.array_except(F.sequence(F.lit(0), F.lit(n_rows * n_cols - 1)), blacks)
    return F.when(~F.array_contains(blacks, -1), fingerprint_text(whites))


def catalogue_names(catalogue: DataFrame, name: str = "grid_name") -> DataFrame:
    """Every catalogue name with the smallest name of the same layout."""
    smallest = catalogue.groupBy(*LAYOUT).agg(F.min(name).alias("canonical_name"))
    return catalogue.join(smallest, LAYOUT).select(name, "canonical_name")


def grid_match(
    fingerprints: DataFrame, catalogue: DataFrame, name: str = "grid_name"
) -> DataFrame:
    """Add the catalogue name of each layout, NULL if there is none.

    Where several names share a layout the smallest is given and ``n_names``
    tells how many there are; :func:`catalogue_names` lists them.  The join is
    an equi join; Spark broadcasts the catalogue while it is small.
    """
    names = catalogue.where(F.col("fingerprint").isNotNull()).groupBy(*LAYOUT).agg(
        F.min(name).alias(name), F.count(F.lit(1)).alias("n_names")
    )
    return fingerprints.join(names, LAYOUT, "left").select(
        *fingerprints.columns, name, F.coalesce("n_names", F.lit(0)).alias("n_names")
    )


def grid_annotate(
    documents: DataFrame,
    matches: DataFrame,
    doc_key: str = "id",
    match_key: str = "crossword_id",
    name: str = "grid_name",
    into: str = "_gridType",
) -> DataFrame:
    """Put the matched grid name into the documents; NULL where nothing matched."""
    found = matches.select(F.col(match_key).alias(doc_key), F.col(name).alias("_found"))
    kept: Sequence[str] = [c for c in documents.columns if c != into]
    return documents.join(found, doc_key, "left").select(*kept, F.col("_found").alias(into))


def grid_usage(matches: DataFrame, name: str = "grid_name", sort: bool = True) -> DataFrame:
    """Puzzles per catalogue grid; puzzles without a match count under NULL."""
    table = matches.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return table.orderBy(F.desc("n"), F.col(name).asc_nulls_last()) if sort else table
