"""Result tables stored in their order, with the number of rows of each range.

A table is range-partitioned by its sort keys and written with one folder per range.  The
rows before a range are then known from a small table of counts, so a page anywhere leads to
the one or few ranges that hold it: these are read and put in order, and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from periodica.operators.tables import DEFAULT_LENGTH, sort_keys

RANGE = "_range"


def _ranged(names: T.StructType) -> T.StructType:
    return T.StructType([*names.fields, T.StructField(RANGE, T.IntegerType())])


@dataclass(frozen=True)
class SortedTable:
    """A stored table: where it is, its order, and (range, rows before it, its rows)."""

    spark: SparkSession
    path: str
    column: int | None
    direction: str
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        """The number of rows, as the ranges have it."""
        return sum(n for _, _, n in self.ranges)

    def page(self, start: int = 0, length: int = DEFAULT_LENGTH) -> DataFrame:
        """The rows from `start` on; a length below 1 means the default length.

        Past the last row a page is empty.  It costs the ranges that it meets.
        """
        if start < 0:
            raise ValueError("start must not be negative")
        length = length if length > 0 else DEFAULT_LENGTH
        met = [r for r in self.ranges if r[1] < start + length and start < r[1] + r[2]]
        names = self.spark.read.parquet(f"{self.path}/columns").schema
        if not met:
            return self.spark.createDataFrame([], names)
        rows = self.spark.read.schema(_ranged(names)).parquet(f"{self.path}/rows")
        rows = rows.where(F.col(RANGE).isin([r[0] for r in met])).drop(RANGE)
        before = met[0][1]
        keys = sort_keys(rows, self.column, self.direction)
        return rows.orderBy(*keys).offset(start - before).limit(length)


def write_sorted(
    table: DataFrame,
    path: str,
    column: int | None = None,
    direction: str = "asc",
    ranges: int | None = None,
) -> SortedTable:
    """Store a table in the order of `tables.table_sort`, and count its ranges.

    The whole row decides among equal keys, so rows of one key may fill many ranges; only
    rows equal in all columns stay together.  Without `ranges` there are as many as the
    session's shuffles have, fewer for a small table.
    """
    keys = sort_keys(table, column, direction)
    dealt = table.repartitionByRange(ranges, *keys) if ranges else table.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumn(RANGE, F.spark_partition_id())
    # Only the folder tells a row's range, so a task writes one file.
    placed.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    table.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    stored = table.sparkSession.read.schema(_ranged(table.schema)).parquet(f"{path}/rows")
    counts = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    order = [F.lit(column).cast("int").alias("column"), F.lit(direction).alias("direction")]
    counts.select(RANGE, "n", *order).write.mode("overwrite").parquet(f"{path}/ranges")
    return read_sorted(table.sparkSession, path)


def read_sorted(spark: SparkSession, path: str) -> SortedTable:
    """A stored table as it was written; the driver holds a row for each range."""
    ranges, before, column, direction = [], 0, None, "asc"
    schema = f"{RANGE} int, n long, column int, direction string"
    for row in sorted(spark.read.schema(schema).parquet(f"{path}/ranges").toLocalIterator()):
        ranges.append((row[RANGE], before, row["n"]))
        before += row["n"]
        column, direction = row["column"], row["direction"]
    return SortedTable(spark, path, column, direction, tuple(ranges))
