"""The stored tables and documents, derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, str], StructType] = {}


class Tables:
    """The parquet tables of one folder, as attributes.

    A table's schema is read from its footer once and then declared, which
    spares every later read the job that infers it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self._folder}/{name}.parquet"
        known = _SCHEMAS.get((self._folder, name))
        if known is not None:
            return self._spark.read.schema(known).parquet(path)
        table = self._spark.read.parquet(path)
        _SCHEMAS[self._folder, name] = table.schema
        return table


def puzzles(t: Tables) -> DataFrame:
    """Orders as puzzles; the customer's nation is the setter."""
    key = F.col("o_orderkey").cast("string")
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return named.select(
        key.alias("id"),
        key.alias("number"),
        F.col("n_name").alias("creator_name"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "cryptic")
        .when(F.col("o_orderstatus") == "P", "prize")
        .otherwise("other")
        .alias("crossword_type"),
        F.when(
            F.col("o_orderkey") % 3 != 0, F.concat(F.lit("http://pdf.example/"), key, F.lit(".pdf"))
        ).alias("pdf"),
    )


def _wordings(t: Tables) -> DataFrame:
    """What an entry says by its part: a reference, a fixed text, or a name and size."""
    key = F.col("p_partkey")
    case = key % 13
    return t.part.select(
        key,
        (key % 25).cast("int").alias("_nation"),
        F.when(case == 0, "").when(case == 1, " across").alias("_suffix"),
        F.when(case == 2, " (6)").when(case == 3, "").alias("_fixed"),
        F.concat("p_name", F.lit(" ")).alias("_name"),
        F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")).alias("_size"),
        F.when(key % 5 == 0, "")
        .otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))))
        .alias("solution"),
    )


def entries(t: Tables) -> DataFrame:
    """Line items as entries; one per order, line number and status."""
    line = F.col("l_linenumber")
    direction = F.when(F.col("l_linestatus") == "F", "across").otherwise("down")
    unique = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_linestatus").agg(
        F.min("l_partkey").alias("_part")
    )
    refer = F.concat(F.lit("See "), (line % 7 + 1).cast("string"), "_suffix")
    return (
        unique.join(_wordings(t), F.col("_part") == F.col("p_partkey"))
        .join(t.nation, F.col("_nation") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("crossword_id"),
            F.concat(line.cast("string"), F.lit("-"), direction).alias("entry_id"),
            line.alias("number"),
            line.cast("string").alias("human_number"),
            direction.alias("direction"),
            F.coalesce(refer, "_fixed", F.concat("_name", "n_name", "_size")).alias("clue"),
            "solution",
        )
    )


def dated(t: Tables) -> DataFrame:
    """Line items as publications of their suppliers."""
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_name").alias("creator_name"), F.col("l_shipdate").cast("date").alias("date")
    )


def grid_entries(t: Tables) -> DataFrame:
    """Entries laid out on 2 x 8 cells: each covers two cells from its number on."""
    return entries(t).select(
        "crossword_id",
        "direction",
        F.lit(2).alias("length"),
        (F.col("number") - 1).alias("pos_x"),
        F.lit(0).alias("pos_y"),
    )


GRID = {"n_rows": 2, "n_cols": 8}


def common_grids(fingerprints: DataFrame, among: int) -> DataFrame:
    """A catalogue of the layouts that at least one of ``among`` puzzles has.

    Layouts of at least three times that many puzzles get a second name.
    """
    total = fingerprints.agg(F.count(F.lit(1))).scalar()
    return _named_grids(fingerprints, F.col("n") * among / total)


def shared_grids(fingerprints: DataFrame, least: int) -> DataFrame:
    """A catalogue of the layouts that at least ``least`` puzzles share, named alike."""
    return _named_grids(fingerprints, F.col("n") / least)


def _named_grids(fingerprints: DataFrame, share: Column) -> DataFrame:
    shape = ["n_rows", "n_cols", "fingerprint"]
    used = (
        fingerprints.groupBy(*shape)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", share)
        .where("share >= 1")
    )
    name = F.concat(F.lit("G"), F.substring(F.md5("fingerprint"), 1, 12))
    names = F.when(F.col("share") >= 3, F.array(name, F.concat(name, F.lit("b")))).otherwise(
        F.array(name)
    )
    return used.select(F.explode(names).alias("grid_name"), *shape)


def document_texts(t: Tables) -> DataFrame:
    """Each order as a nested JSON document, with gaps and a few defects.

    Orders of priority 5 have no creator, of priority 4 a creator of blanks and
    of priority 3 one with trailing blanks; priority 2 documents lack the date
    and the number.  Documents of the kind "other" are cut off before their end
    when their total price is below 100000.
    """
    p, e = puzzles(t), entries(t)
    item = F.struct(
        F.col("entry_id").alias("id"),
        "number",
        F.col("human_number").alias("humanNumber"),
        "clue",
        "direction",
        F.when(F.col("solution") != "", F.length("solution")).alias("length"),
        F.when(F.col("solution") != "", F.col("solution")).alias("solution"),
        F.struct((F.col("number") - 1).alias("x"), F.lit(0).alias("y")).alias("position"),
    )
    lists = e.groupBy(F.col("crossword_id").alias("id")).agg(
        F.array_sort(F.collect_list(item)).alias("entries")
    )
    extra = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.substring("o_orderpriority", 1, 1).alias("_level"),
        "o_totalprice",
    )
    level = F.col("_level")
    creator = (
        F.when(level == "5", F.lit(None))
        .when(level == "4", F.lit("  "))
        .when(level == "3", F.concat("creator_name", F.lit(" \t")))
        .otherwise(F.col("creator_name"))
    )
    document = F.struct(
        "id",
        F.when(level != "2", F.col("number").cast("bigint")).alias("number"),
        F.concat(F.lit("Puzzle No "), "number").alias("name"),
        F.when(creator.isNotNull(), F.struct(creator.alias("name"))).alias("creator"),
        F.when(level != "2", F.unix_date("date").cast("double") * 86400000.0).alias("date"),
        F.col("crossword_type").alias("crosswordType"),
        "pdf",
        F.coalesce("entries", F.array()).alias("entries"),
    )
    text = F.to_json(document)
    broken = (F.col("crossword_type") == "other") & (F.col("o_totalprice") < 100000)
    return (
        p.join(extra, "id")
        .join(lists, "id", "left")
        .select("id", text.alias("_t"), broken.alias("_broken"))
        .select(
            "id",
            F.when(F.col("_broken"), F.expr("left(_t, length(_t) - 2)"))
            .otherwise(F.col("_t"))
            .alias("text"),
        )
    )
