from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_every_stage_works_on_what_the_one_before_kept(spark, docs_of, hard_texts, tmp_path):
    long = " ".join(f"word{i}" for i in range(90))
    rows = list(enumerate(hard_texts)) + [
        (2000 + i, f"{long} extra{i} mail me at user{i}@example.com now " + " ".join(f"k{i}x{j}" for j in range(300)))
        for i in range(4)
    ]
    # Hosts of good documents only, or of bad ones.
    rows = [(i, t, f"host{i % 3}" if not brute.quality(t)[5] else "junk") for i, t in rows]
    documents = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    left = {i: t for i, t, _ in rows if not brute.quality(t)[5]}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def after(k):
        done = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        path = str(tmp_path / str(k))
        done.write.parquet(path)
        return spark.read.parquet(path)

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    docs = after(0)
    assert docs.columns == documents.columns and texts(docs) == left
    components = brute.documents_by_shingles(list(left.items()))
    left = {i: t for i, t in left.items() if components[i][1] == i}
    docs = after(1)
    assert docs.columns == documents.columns and texts(docs) == left
    figures = brute.without_repeats(list(left.values()))
    docs = after(2)
    got = texts(docs)
    assert {i: len(t.encode()) for i, t in got.items()} == {i: n - gone for i, (n, gone, *_) in zip(left, figures)}
    assert any(gone for _, gone, *_ in figures)
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    docs = after(3)
    redacted = texts(docs)
    assert all("<EMAIL>" in redacted[2000 + i] and "@" not in redacted[2000 + i] for i in range(4))
    packed = after(4)
    assert packed.select("doc_id").distinct().count() == len(left)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()
