"""Incremental arrival of documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from periodica.sources.documents import SUFFIX, parse_texts, with_provenance
from periodica.sources.store import land, read_entries, read_puzzles  # noqa: F401


def document_stream(
    spark: SparkSession,
    roots: str | Sequence[str],
    lines: bool = False,
    suffix: str = SUFFIX,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Documents of the files below the folders, each file read once.

    The folders rank as listed, as in ``scan_json``: among documents of one id
    that arrive together, that of the first folder wins.
    """
    parts = []
    for rank, root in enumerate([roots] if isinstance(roots, str) else roots):
        reader = spark.readStream.option("wholetext", not lines).option("pathGlobFilter", suffix)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        parts.append(with_provenance(reader.option("recursiveFileLookup", True).text(root), rank))
    return parse_texts(reduce(DataFrame.unionByName, parts), lines)


def stream_ingest(docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append new puzzles and entries to the store as documents arrive.

    The stream's checkpoint is the high-water mark.  Every micro-batch is a
    delivery named after it, so a replay after a failure replaces its own output.
    """

    def land_batch(batch: DataFrame, batch_id: int) -> None:
        land(batch, store, f"stream-{batch_id:06d}")

    return (
        docs.writeStream.foreachBatch(land_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
