"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots.  The bytes of each slot are summed, and a
map from slots to shards is kept as numbered versions.  A rebalance edits the map: slots
stay where they are as long as their shard has room, and only the others move.  Everything
that is decided is decided on the slots, whose number does not grow with the records.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from periodica.llm.common import staged, text_or_empty
from periodica.session import work_dir

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16
# Equal rows are numbered in blocks of so many, each in any task.
BLOCK = 1000


def with_slot(records: DataFrame, *keys: str, slots: int = SLOTS) -> DataFrame:
    """Adds the virtual slot of each record, from all the key columns.

    Keys may be null.  Equal keys share a slot, so give enough columns to tell rows apart.
    """
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def numbered(records: DataFrame) -> DataFrame:
    """Adds `copy`, from 0 on among rows that are equal in all columns.

    Equal rows are counted and made again, so however many there are no task holds them all.
    """
    groups = records.groupBy(*records.columns).agg((F.count(F.lit(1)) - 1).alias("_last"))
    groups = staged(groups, "groups")
    blocks = groups.where(F.col("_last") >= BLOCK).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / BLOCK)))
    )
    blocks = blocks.repartition("_block", "_last")
    few = groups.where(F.col("_last") < BLOCK).withColumn("_block", F.lit(0).cast("bigint"))
    first = F.col("_block") * BLOCK
    copies = F.sequence(first, F.least(first + BLOCK - 1, F.col("_last")))
    return few.unionByName(blocks).withColumn("copy", F.explode(copies)).drop("_last", "_block")


def slot_totals(records: DataFrame, size: str) -> DataFrame:
    """Rows and bytes of each slot that has rows."""
    return records.groupBy("virtual_slot").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes")
    )


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots in turn, whatever they hold."""
    return spark.range(slots).select(
        F.lit(0).alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
    )


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: shards of near equal bytes, for this number of shards.

    In each shard the largest slots stay while their sum is within an equal share.  The
    other slots, and those of shards that are no more, go in falling size to the shard that
    has the fewest bytes by then.  Slots without rows stay where they are, or go round.
    """
    every = slot_map.join(totals, "virtual_slot", "left").select(
        "version",
        "virtual_slot",
        F.when(F.col("shard") < shards, F.col("shard")).alias("shard"),
        F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    falling = Window.partitionBy("shard").orderBy(F.desc("n_bytes"), "virtual_slot")
    share = every.agg(F.ceil(F.sum("n_bytes") / F.lit(shards))).scalar()
    running = F.sum("n_bytes").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    marked = every.withColumn(
        "stays", F.col("shard").isNotNull() & ((running <= share) | (F.col("n_bytes") == 0))
    )

    # One row, of a fixed number of slots: what stays, and the others in falling size.
    def give(state: Column, item: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(
                state["loads"], lambda load, i: F.when(i == at, load + item["n_bytes"]).otherwise(load)
            ).alias("loads"),
            F.array_append(state["chosen"], at).alias("chosen"),
        )

    own = lambda i: F.aggregate(
        F.filter("staying", lambda s: s["shard"] == i), F.lit(0).cast("bigint"), lambda a, s: a + s["n_bytes"]
    )
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), own).alias("loads"),
        F.array().cast("array<int>").alias("chosen"),
    )
    one = marked.agg(
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "n_bytes"))).alias("staying"),
        F.sort_array(
            F.collect_list(F.when(~F.col("stays"), F.struct("n_bytes", "virtual_slot"))), asc=False
        ).alias("queue"),
    )
    moves = (
        one.select("queue", F.aggregate("queue", start, give)["chosen"].alias("chosen"))
        .select(F.explode(F.arrays_zip("queue", "chosen")).alias("move"))
        .select(
            F.col("move.queue.virtual_slot").alias("virtual_slot"),
            F.col("move.chosen").alias("moved_to"),
        )
    )
    return marked.join(moves, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.coalesce("moved_to", "shard").alias("shard"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Writes one version beside those that are stored."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; the last one by default."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is not None:
        return stored.where(F.col("version") == version)
    last = stored.agg(F.max("version").alias("version"))
    return stored.join(F.broadcast(last), "version")


def assign(records: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, gapless from 0.

    A shard's places are laid out slot by slot, so no task numbers a whole shard; in a slot
    records go by doc_id (nulls first), then size and checksum.
    """
    layout = Window.partitionBy("shard").orderBy("virtual_slot")
    based = slot_map.join(totals, "virtual_slot").select(
        "virtual_slot",
        "shard",
        (F.sum("n_rows").over(layout) - F.col("n_rows")).alias("_base"),
    )
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (
        records.withColumn("_place", F.row_number().over(place) - 1)
        .join(F.broadcast(based), "virtual_slot")  # at most as many rows as slots
        .withColumn("slot", (F.col("_base") + F.col("_place")).cast("bigint"))
        .drop("_base", "_place")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot of every document.

    The law is `bytes`: the shards' sizes are near equal.  Sizes are the UTF-8 bytes of the
    text (null: none) plus 16.  Rows with null or repeated ids are rows like any other;
    other columns are dropped; an empty table gives an empty one.  The versions of the map
    are stored at map_path, by default below spark.checkpoint.dir, and the new one is read
    from there; where versions are stored already, the last of them is rebalanced.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    records = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    keys = ("doc_id", "size", "text_crc32")
    plain = with_slot(numbered(records), *keys, slots=slots)
    spread = with_slot(plain.withColumnRenamed("virtual_slot", "_first"), *keys, "copy", slots=slots)
    slot = F.when(F.col("copy") == 0, F.col("_first")).otherwise(F.col("virtual_slot"))
    records = staged(spread.withColumn("virtual_slot", slot).drop("_first", "copy"), "records")
    totals = staged(slot_totals(records, "size"), "totals")
    path = map_path or work_dir(spark, "slot-map")
    try:
        before = staged(read_map(spark, path), "slot-map-before")
    except AnalysisException:  # nothing is stored yet
        before = first_map(spark, shards, slots)
        store_map(before, path)
    store_map(staged(rebalanced(before, totals, shards), "slot-map-after"), path)
    return assign(records, read_map(spark, path), totals)
