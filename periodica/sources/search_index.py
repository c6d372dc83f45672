"""Uses of a named table stored by ranges of their groups, with an inverted index of trigrams.

All uses of a group are in one part, a folder of its own.  The index names, for each column
and each three characters in a row that occur in it, the parts that have them.  A search
reads the parts that have all trigrams of it, and tests each use there as the search without
an index does, so the index decides what is read and never what is found.  A search without
three characters in a row reads every part.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from periodica.operators.tables import (
    NamedTable, search_condition, search_pattern, stored_rows, table_counts, table_groups,
)
from periodica.sources.store import _remove

PART = "_part"
GRAM = 3
# Parts of a stored table unless told otherwise; an entry of the index lists as many at most.
PARTS = 1024
# A match at every place, each with the characters that follow it.
_GRAMS = rf"(?s)(?=(.{{{GRAM}}}))"

# A search and the columns any of which may contain it.
Condition = tuple[str, Sequence[str]]


def _with_part(names: T.StructType) -> T.StructType:
    return T.StructType([*names.fields, T.StructField(PART, T.IntegerType())])


def _lower(text: Column) -> Column:
    return F.lower(text.cast("string"))


def _grams_of(column: str) -> Column:
    """(column, gram) of the different grams of a use; a null has none."""
    text = F.coalesce(_lower(F.col(column)), F.lit(""))
    return F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(_GRAMS), 1)),
        lambda gram: F.struct(F.lit(column).alias("column"), gram.alias("gram")),
    )


def _grams(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    grams = F.explode(F.concat(*map(_grams_of, columns)))
    return table.select(PART, grams.alias("_g")).select(PART, "_g.column", "_g.gram")


def write_search_index(spec: NamedTable, rows: DataFrame, path: str, parts: int = PARTS) -> SearchIndex:
    """Store the uses behind a named table with their index, and its groups.

    Groups are dealt by ranges of their keys and uses follow their group, so the uses of one
    large group are one part, of as many files as they fill.  Groups are reduced here, once
    for all searches.  Grams are reduced by part in the tasks before they are shuffled.
    """
    spark, keys = rows.sparkSession, list(spec.keys)
    rows = stored_rows(rows, f"{path}/uses")
    # Ranges are cut by a sample: written once, they are the same for every reader and retry.
    grouped = table_groups(spec, rows) if spec.joined else rows.select(*keys).distinct()
    dealt = grouped.repartitionByRange(parts, *keys)
    numbered = dealt.withColumn(PART, F.spark_partition_id())
    numbered.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/groups")
    groups = spark.read.schema(_with_part(grouped.schema)).parquet(f"{path}/groups")
    grouped.limit(0).write.mode("overwrite").parquet(f"{path}/group_columns")
    same = reduce(and_, [rows[k].eqNullSafe(groups[k]) for k in keys])
    placed = rows.join(groups.select(*keys, PART), same).select(*[rows[c] for c in rows.columns], groups[PART])
    # Parts that are too large for a task become several files, small ones share a task.
    placed.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")

    _remove(spark, f"{path}/uses")

    stored = spark.read.schema(_with_part(rows.schema)).parquet(f"{path}/rows")
    # A group has its keys once, however many uses.
    texts = _texts(spec, rows.columns)
    found = _grams(groups, [c for c in texts if c in keys])
    if others := [c for c in texts if c not in keys]:
        found = found.unionByName(_grams(stored, others))
    found = found.distinct()
    lists = found.groupBy("column", "gram").agg(F.array_sort(F.collect_set(PART)).alias("parts"))
    lists.sort("column", "gram").write.mode("overwrite").parquet(f"{path}/grams")
    return SearchIndex(spark, spec, path)


def _texts(spec: NamedTable, columns: Sequence[str]) -> list[str]:
    """The columns of a use that the named table lets one search, or joins."""
    wanted = dict.fromkeys([*spec.keys, *spec.searchable])
    return [c for c in wanted if c in columns]


@dataclass(frozen=True)
class SearchIndex:
    """A stored table that can be searched without reading all of it."""

    spark: SparkSession
    spec: NamedTable
    path: str

    def _grams(self, search: str, literal: bool) -> set[str]:
        """What a text must have to contain the search, in lower case as the test has it."""
        pattern, escape = search_pattern(search, literal)
        # Lower case can depend on neighbours, so the pattern is changed whole, by Spark.
        whole = self.spark.createDataFrame([(pattern,)], "p string").select(_lower(F.col("p"))).first()[0]
        kept = re.split(rf"(?<!{re.escape(escape)})[%_]", whole)
        runs = [r.replace(escape, "") for r in kept]
        return {r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)}

    def parts(self, conditions: Sequence[Condition], literal: bool = False) -> list[int] | None:
        """The parts in which every condition can hold; None if any part may do.

        Looks up the grams of the searches, each with one list of at most all parts.
        """
        needed = [(self._grams(search, literal), columns) for search, columns in conditions if search]
        needed = [(grams, columns) for grams, columns in needed if grams]
        if not needed:
            return None
        index = self.spark.read.schema("column string, gram string, parts array<int>").parquet(
            f"{self.path}/grams"
        )
        asked = index.where(
            F.col("column").isin(sorted({c for _, columns in needed for c in columns}))
            & F.col("gram").isin(sorted(set().union(*[grams for grams, _ in needed])))
        )
        lists = {(r["column"], r["gram"]): set(r["parts"]) for r in asked.toLocalIterator()}

        def holding(grams: set[str], column: str) -> set[int]:
            return set.intersection(*[lists.get((column, g), set()) for g in grams])

        return sorted(
            set.intersection(*[set().union(*[holding(g, c) for c in columns]) for g, columns in needed])
        )

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The stored uses, of the given parts or all."""
        names = self.spark.read.parquet(f"{self.path}/columns").schema
        return self._of_parts("rows", names, parts)

    def search(self, search: str, literal: bool = False) -> DataFrame:
        """The groups with a use of which any searchable column contains the search."""
        return self._found([(search, self.spec.searchable)], literal)

    def column_search(self, searches: Mapping[str, str], literal: bool = False) -> DataFrame:
        """The groups that have, for every named column, a use in which it contains its search."""
        columns = set(_texts(self.spec, self.rows().columns))
        if unknown := set(searches) - columns:
            raise ValueError(f"not searchable: {sorted(unknown)}")
        return self._found([(s, [c]) for c, s in searches.items()], literal)

    def filtered(self, search: str, literal: bool = False) -> DataFrame:
        """One row with the number of groups that a search keeps, `records_filtered`."""
        parts = self.parts([(search, self.spec.searchable)], literal)
        return table_counts(self.spec, self.rows(parts), search, literal).select("records_filtered")

    def groups(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The stored groups, of the given parts or all."""
        names = self.spark.read.parquet(f"{self.path}/group_columns").schema
        return self._of_parts("groups", names, parts)

    def _of_parts(self, folder: str, names: T.StructType, parts: Sequence[int] | None) -> DataFrame:
        stored = self.spark.read.schema(_with_part(names)).parquet(f"{self.path}/{folder}")
        if parts is not None:
            stored = stored.where(F.col(PART).isin(list(parts)) if parts else F.lit(False))
        return stored.drop(PART)

    def _found(self, conditions: Sequence[Condition], literal: bool) -> DataFrame:
        parts = self.parts(conditions, literal)
        tests = [search_condition(s, columns, literal) for s, columns in conditions if s]
        if not self.spec.joined:
            return table_groups(self.spec, self.rows(parts), tests)
        groups, keys = self.groups(parts), list(self.spec.keys)
        if not tests:
            return groups
        # Only uses that pass a test are grouped; what a group has is stored with it.
        holds = [F.max(F.coalesce(test, F.lit(False))) for test in tests]
        found = self.rows(parts).where(reduce(or_, tests)).groupBy(*keys).agg(reduce(and_, holds).alias("_all"))
        found = found.where("_all")
        return groups.join(found, reduce(and_, [groups[k].eqNullSafe(found[k]) for k in keys]), "left_semi")
