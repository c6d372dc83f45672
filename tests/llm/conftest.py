import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names the operators use."""

    def build(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return (
            spark.createDataFrame(full, DOCS)
            .repartition(3)
            .withColumns({c: F.lit("x") for c in ("kept", "node", "base", "spans", "runs", "_row", "text_id", "n_words")})
        )

    return build


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):03d}" for _ in range(n))


@pytest.fixture(scope="session")
def hard_texts():
    """Near and exact copies, shared passages, junk, and every kind of odd text."""
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "one", "one two three four", "One TWO three four", "é" * 300, "\x0b\x0c a \r\n b"]
    for _ in range(6):
        words = prose(rng, rng.choice((30, 120, 400))).split()
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(words).upper())
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)]
    texts += ["spam and eggs\n" * 60, "spam and eggs\n" * 60, prose(rng, 30_000, 5_000), "a" * 1000]
    texts += ["ñandú 日本語 🙂 " * 40, "x" + "ñandú 日本語 🙂 " * 40]
    texts += [prose(rng, n) for n in range(3, 40)]
    return texts
