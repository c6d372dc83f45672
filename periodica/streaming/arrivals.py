"""Arrival of documents with keyed state: what is new is known without reading the store.

Two streams run one after the other.  The first parses the documents that have arrived,
stores them as they are, one folder for each micro-batch, and beside them the first row of
each id.  The second reads only these ids and drops those that its state has seen.  For the
ids that are left the documents are fetched from the arrivals that have not landed yet, and
land as a delivery.  So a delivery costs its own size and a look-up of state for each of its
ids, however many the store holds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from periodica.schemas import CORRUPT, REASON, SCANNED
from periodica.sources.documents import stage
from periodica.sources.store import (
    _remove, first_rows, land_new, landed_names, numbered_rows, read_puzzles,
)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The names of deliveries and arrivals; the ids known at the beginning come before them.
OWN, KNOWN = "arrival-", "0-known"
# The first row of an id in an arrival; a known id has none.
FIRSTS = "id string, row long, arrival string"
ARRIVED = T.StructType(
    [*SCANNED.fields, T.StructField("row", T.LongType()), T.StructField("arrival", T.StringType())]
)


def _begin(spark: SparkSession, store: str) -> None:
    """Note the deliveries that the store has, and their ids as the first to be known.

    After that, a delivery of others is an error: the state would not know its ids.
    """
    marks = f"{store}/stream-begins"
    others = {n for n in landed_names(spark, store) if not n.startswith((OWN, "compact-"))}
    try:
        begun = {r.name for r in spark.read.schema("name string").parquet(marks).toLocalIterator()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = read_puzzles(spark, store).select("id", F.lit(None).cast("long").alias("row"))
        known.write.mode("overwrite").parquet(f"{store}/firsts/arrival={KNOWN}")
        names = spark.createDataFrame([(n,) for n in sorted(others)], "name string")
        names.coalesce(1).write.mode("overwrite").parquet(marks)
        return
    if late := sorted(others - begun):
        raise ValueError(f"the store has deliveries that its stream does not know: {', '.join(late)}")


def stage_arrivals(docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Store the documents of a stream as they arrive, parsed once, their ids and the rejects."""

    def put(batch: DataFrame, batch_id: int) -> None:
        name = f"{OWN}{batch_id:06d}"
        numbered = batch.withColumn("row", F.monotonically_increasing_id())
        arrived = stage(numbered, f"{store}/arrivals/arrival={name}")
        bad = arrived.where(F.col(REASON).isNotNull()).drop("row")
        bad.write.mode("overwrite").parquet(f"{store}/rejected/batch={name}")
        good = arrived.where(F.col(REASON).isNull())
        stage(first_rows(good), f"{store}/firsts/arrival={name}")

    return (
        docs.writeStream.foreachBatch(put)
        .option("checkpointLocation", f"{checkpoint}/arrivals")
        .trigger(availableNow=True)
        .start()
    )


def land_first(
    spark: SparkSession, store: str, checkpoint: str, with_partials: bool = False
) -> StreamingQuery:
    """Land the documents of the ids that the state does not know."""

    def land_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{OWN}{batch_id:06d}"
        work = f"{store}/work/{name}"
        new = stage(batch.select("id"), f"{work}/ids")
        # A new id may be in several arrivals that have not landed, and in no other one: the
        # earliest has it.  If the store had it before, that is where it is first.
        firsts = spark.read.schema(FIRSTS).parquet(f"{store}/firsts")
        places = (
            firsts.join(new, "id", "left_semi")
            .groupBy("id")
            .agg(F.min(F.struct("arrival", "row")).alias("first"))
            .where(F.col("first.arrival") != KNOWN)
            .select("first.*")
        )
        docs = spark.read.schema(ARRIVED).parquet(f"{store}/arrivals")
        docs = numbered_rows(docs, places, f"{work}/places", ["arrival"])
        docs = docs.drop("arrival", "row", CORRUPT, REASON).withColumn("id", F.coalesce("id", F.lit("")))
        land_new(stage(docs, f"{work}/new"), store, name, with_partials)
        _remove(spark, work)

    firsts = spark.readStream.schema(FIRSTS).parquet(f"{store}/firsts")
    landing = (
        firsts.dropDuplicates(["id"])
        .writeStream.foreachBatch(land_batch)
        .outputMode("append")
        .option("checkpointLocation", f"{checkpoint}/firsts")
        .trigger(availableNow=True)
    )
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)  # a query keeps the settings that it starts with
    try:
        return landing.start()
    finally:
        spark.conf.set(STATE_STORE, before)


def ingest_arrivals(
    docs: DataFrame, store: str, checkpoint: str, with_partials: bool = False
) -> None:
    """Append the new puzzles and entries among what has arrived, and return.

    Of documents with one id the first counts, by arrival and then in reading order; ids
    that the store held before the stream began count as known.  From then on the state
    alone tells what is known, so only this stream and compactions may write to the store;
    other deliveries are an error.  A run that fails is taken up by the next: arrivals are
    complete before any of them lands, and go when all have landed.
    """
    spark = docs.sparkSession
    _begin(spark, store)
    stage_arrivals(docs, store, checkpoint).awaitTermination()
    try:
        arrived = spark.read.schema(ARRIVED).parquet(f"{store}/arrivals").select("arrival").distinct()
        names = [r.arrival for r in arrived.toLocalIterator()]  # one for each since the last run
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    land_first(spark, store, checkpoint, with_partials).awaitTermination()
    for name in names:
        _remove(spark, f"{store}/arrivals/arrival={name}")
        if name != KNOWN:
            _remove(spark, f"{store}/firsts/arrival={name}")
