"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm import (
    bpe,
    dialogue,
    embeddings,
    htmltext,
    ngrams,
    packing,
    periods,
    pii,
    quality,
    records,
    sharding,
    substrings,
    warc,
)
from periodica.llm.common import table
from periodica.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_subspace(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op2_parity_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, folder, "documents"))


def op3_prefix_free(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removed(table(spark, folder, "documents"))


def op4_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op5_merge_replay(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), RANKS)


def op6_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).drop("source")


def op7_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), VOCABULARY))


def op8_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, keep_text=False)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text("base"), 256).alias("base_sha256"),
        pii.spans_text("spans").alias("spans"),
    )


def op9_equivalence_classes(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.main_texts(table(spark, folder, "pages"))


def op10_salvage(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_round_trip(table(spark, folder, "pages")).drop("url")


def op11_basic_factors(spark: SparkSession, folder: str) -> DataFrame:
    return periods.run_digests(periods.with_planted_runs(table(spark, folder, "documents")))


def op12_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    files = work_dir(spark, "records")
    records.write_tokens(table(spark, folder, "documents"), files, WORD_VOCABULARY)
    return records.record_digests(spark, files)


def op13_edit_lattice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return dialogue.audit_conversations(dialogue.damaged(rows), every=rows)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_subspace,
        op2_parity_sketch,
        op3_prefix_free,
        op4_virtual_slots,
        op5_merge_replay,
        op6_host_rules,
        op7_best_fit,
        op8_bootstrap,
        op9_equivalence_classes,
        op10_salvage,
        op11_basic_factors,
        op12_binary_records,
        op13_edit_lattice,
    )
}

ORACLES: dict[str, str] = {"op6_host_rules": quality.ORACLE}
