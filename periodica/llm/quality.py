"""Quality rules for documents, and for the hosts that failing documents come from.

The rules are built-in expressions over each whole text.  Failures are counted by host; a
host's rate is drawn towards the rate of all hosts by a beta prior fitted to them, so that a
host with few documents is not judged by chance; documents of hosts beyond the limit go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from periodica.llm.common import put_back, set_aside, staged, text_or_empty, words_of

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
HOST_LIMIT = 0.5
# Bounds of the prior's weight, in documents: hosts all alike, or as far apart as can be.
PRIOR_WEIGHT = (1.0, 1e6)
# Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur more than once; windows: sorted (hash, place)."""
    twice = F.filter(
        windows,
        lambda w, i: (w["hash"] == F.get(windows, i - 1)["hash"]).eqNullSafe(True)
        | (w["hash"] == F.get(windows, i + 1)["hash"]).eqNullSafe(True),
    )
    places = F.sort_array(F.transform(twice, lambda w: w["place"]))
    return F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered")),
        lambda state, p: F.struct(
            p.alias("last"), (state["covered"] + F.least(F.lit(3), p - state["last"])).alias("covered")
        ),
        lambda state: state["covered"],
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words and fails.  Three-word windows are compared by a 64-bit hash
    within their text.
    """
    words = F.col("_words")
    size = F.size(words)
    hashed = F.when(
        size >= 3,
        F.transform(
            F.sequence(F.lit(0), size - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("hash"),
                i.alias("place"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # Each step is a projection of its own: what a function looks into is computed once.
    return (
        docs.withColumn("_text", text_or_empty(text))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": size.cast("bigint"),
                "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
                "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "_windows": F.sort_array(hashed),
            }
        )
        .withColumn("n_repeat_words", _repeated_words(F.col("_windows")).cast("bigint"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
        .drop("_text", "_words", "_lines", "_windows")
    )


def host_verdicts(flagged: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, n_failed, rate (shrunk) and host_failed of every host, the null one included.

    flagged: rows with the host and base_failed.  The prior's mean and weight are those of
    the hosts' rates by the method of moments.
    """
    hosts = flagged.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("n_failed")
    )
    hosts = staged(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n")
    mean, spread = F.avg(rate), F.var_pop(rate)
    weight = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(PRIOR_WEIGHT[1])
    prior = hosts.agg(
        F.struct(
            mean.alias("mean"),
            F.least(F.greatest(weight, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])).alias("weight"),
        )
    ).scalar()
    shrunk = (F.col("n_failed") + prior["mean"] * prior["weight"]) / (F.col("n") + prior["weight"])
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > limit)


def judged(docs: DataFrame, limit: float = HOST_LIMIT, keep_documents: bool = False) -> DataFrame:
    """doc_id, source, the measures, base_failed and kept of every document.

    Every row stays, also those with null or repeated ids; a null source is a host like any
    other; an empty table gives an empty one.  With keep_documents the text and, in the
    struct `_rest`, the other columns come along.  The rows are staged once, since the
    hosts' rates need them all.  A host is joined by its name; where the table of hosts is
    too large to send around, adaptive execution splits a hot one.
    """
    rows = set_aside(docs, "doc_id", "source", "text")
    rows = measured(rows) if keep_documents else measured(rows.drop("_rest")).drop("text")
    flagged = staged(rows, "measured")
    verdicts = host_verdicts(flagged, "source", limit).select(
        F.col("source").alias("_host"), "host_failed"
    )
    verdicts = staged(verdicts, "verdicts")
    return (
        flagged.join(verdicts, F.col("source").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
        .drop("_host", "host_failed")
    )


def kept_documents(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The documents, all columns as they were, that neither the rules nor their host reject."""
    return put_back(judged(docs, limit, keep_documents=True).where("kept"), docs.columns)


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), tri AS (
    SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
    SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), m AS (
    SELECT doc_id, source, len(ws)::BIGINT AS n_words,
           length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered USING (rid)
), f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
    SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source
), p AS (
    SELECT avg(k / n) AS mean, var_pop(k / n) AS spread FROM h
), b AS (
    SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1
                                     ELSE 1e6 END, 1.0), 1e6) AS weight FROM p
), v AS (
    SELECT source, (k + mean * weight) / (n + weight) > 0.5 AS host_failed FROM h, b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
