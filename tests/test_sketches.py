"""Distinct answers estimated from sketches that unite."""

import datetime

from pyspark.sql import functions as F

from periodica.operators import words

PUZZLES = "id string, creator_name string, date date"
ENTRIES = "crossword_id string, solution string"


def archive(spark):
    puzzles = [(str(k), "Ann" if k % 3 else "Bea", datetime.date(2000 + k % 4, 1, 1 + k % 28)) for k in range(60)]
    entries = [(str(k), f"W{(k * 7 + j) % 90}") for k in range(60) for j in range(5)]
    entries += [(str(k), "") for k in range(60)] + [("0", None), ("99", "LOST")]
    return spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(puzzles, PUZZLES)


def test_small_counts_are_exact(spark):
    e, p = archive(spark)
    exact = words.unique_ratio(e, p)
    got = words.unique_ratio(e, p, approx=True)
    assert got.columns == exact.columns
    assert list(map(tuple, got.collect())) == list(map(tuple, exact.collect()))
    assert words.unique_ratio(e.limit(0), p, approx=True).count() == 0


def test_sketches_of_deliveries_unite(spark):
    e, p = archive(spark)
    whole = list(map(tuple, words.unique_ratio(e, p).collect()))
    parts = [words.answer_sketches(e, p.where(F.col("id").cast("int") % 3 == k)) for k in (2, 0, 1)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert list(map(tuple, words.ratio_of_sketches(united).collect())) == whole


def test_large_counts_are_close_and_no_answer_is_shuffled(spark):
    p = spark.createDataFrame([("1", "Ann", datetime.date(2001, 1, 1))], PUZZLES)
    e = spark.range(300_000).select(F.lit("1").alias("crossword_id"), F.concat(F.lit("w"), F.col("id") % 200_000).alias("solution"))
    got = words.unique_ratio(e, p, approx=True)
    row = got.first()
    assert row.total_solutions == 300_000 and abs(row.unique_solutions - 200_000) < 200_000 * 4 * 1.04 / 128
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[creator_name" in plan and ", solution" not in plan.split("hll_sketch_agg")[0].split("HashAggregate")[-1]
