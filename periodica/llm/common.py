"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.session import work_dir

# The white space that separates words (space and U+0009 to U+000D).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"

BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared work folder and read back.

    The table replaces the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, split at the fixed white space; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WHITE_CLASS + "+")
    )


def text_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch down to what whole texts ask for.

    The session's default of 10,000 rows is made for narrow rows: with texts of some KB the
    buffers on both sides of a Python worker would take hundreds of MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null ones are empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def set_aside(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns named, and all others in a struct `_rest`, so that names cannot clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*rest, F.lit(1).alias("_")).alias("_rest"))


def put_back(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their first order; those not set aside are taken as they are now."""
    here = set(docs.columns)
    return docs.select(
        *[F.col(f"`{c}`") if c in here else F.col("_rest").getField(c).alias(c) for c in columns]
    )
