"""Grid catalogue: one text of comma-separated 0/1 lines per grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.operators.grids import fingerprint_text

SUFFIX = "*.grid"


def file_stem(path: Column) -> Column:
    """File name without folder and without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?\z", 1)


def parse_grid(grids: DataFrame, name: Column, text: Column) -> DataFrame:
    """Name, dimensions and white-cell fingerprint (1 is white) of grid texts.

    ``reason`` tells why a text is not a grid, and is NULL for grids: it has no
    lines, lines of different lengths, or marks that are no numbers.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
    rows = F.transform(F.col("_lines"), lambda s: F.split(s, ","))
    marks = F.transform(F.flatten("_rows"), lambda m: F.trim(m).try_cast("double"))
    whites = F.filter(
        F.transform(F.col("_marks"), lambda m, i: F.when(m == 1.0, i)), lambda i: i.isNotNull()
    )
    widths = F.array_distinct(F.transform("_rows", lambda r: F.size(r)))
    reason = (
        F.when(F.size("_rows") == 0, "no lines")
        .when(F.size(widths) > 1, "lines of different lengths")
        .when(F.exists("_marks", lambda m: m.isNull()), "not a number")
    )
    return (
        grids.select(name.alias("grid_name"), lines.alias("_lines"))
        .withColumn("_rows", rows)
        .withColumn("_marks", marks)
        .select(
            "grid_name",
            F.size("_rows").alias("n_rows"),
            F.size(F.get("_rows", 0)).alias("n_cols"),
            fingerprint_text(whites).alias("fingerprint"),
            reason.alias("reason"),
        )
    )


def grid_scan(
    spark: SparkSession, path: str, name: Column | None = None, suffix: str = SUFFIX
) -> tuple[DataFrame, DataFrame]:
    """Grids of the ``.grid`` files of a folder, and the files (name, reason) that are none.

    The name is the file stem unless given; other files are not looked at.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=suffix)
    stem = file_stem(F.col("_metadata.file_name")) if name is None else name
    parsed = parse_grid(files, stem, F.col("value"))
    good = parsed.where(F.col("reason").isNull()).drop("reason")
    return good, parsed.where(F.col("reason").isNotNull()).select("grid_name", "reason")
