import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import embeddings, ngrams, substrings
from tests.llm import brute


def at_the_threshold(size):
    """Sets of about `size` shingles, many with just as few in common as still links."""
    rng = random.Random(size)
    words = [f"{size}v{i}" for i in range(size + 4)]
    texts = [" ".join(words)]
    for _ in range(60):
        other = list(words)
        for _ in range(rng.randrange(3)):
            if rng.random() < 0.5:
                other = other[: len(other) - rng.randrange(1, 3)] or other
            else:
                other += [f"{size}t{rng.randrange(9)}" for _ in range(rng.randrange(1, 3))]
        texts.append(" ".join(other))
    return texts


def chain():
    """Texts similar to those near them only, so that the smallest of a key may not be."""
    rng = random.Random(3)
    base = [f"c{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(1, 80):
        at = rng.randrange(0, 170)
        base = base[:at] + [f"n{i}_{k}" for k in range(3)] + base[at + 3 :]
        texts.append(" ".join(base))
    return texts


def test_shingle_links_are_those_of_brute_force(docs_of, hard_texts):
    texts = hard_texts + chain() + [t for n in (1, 2, 4, 5, 6, 9, 17, 40) for t in at_the_threshold(n)]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.documents_by_shingles(rows)


def test_near_copies_meet_at_a_centre_not_each_other(docs_of, monkeypatch):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(300):  # near copies, of which some are too far from the smallest one to link
        copy = list(base)
        for at in rng.sample(range(140), rng.randrange(0, 5)):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    counts = {}
    write = ngrams.staged

    def counted(df, label):
        out = write(df, label)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(ngrams, "staged", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.documents_by_shingles(rows)
    assert sum(counts["centre-links"]) > 0
    assert sum(counts["others"]) <= len(rows)


def test_crowded_triggers_are_told_apart_by_their_nearest_changes(docs_of, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts = [base, base]
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(500), rng.randrange(1, 4)):
            copy[at] = rng.choice("uvwxyz")
        texts.append("".join(copy)[rng.randrange(40) :])
    counts = []
    write = substrings.staged

    def counted(df, label):
        out = write(df, label)
        if label == "found":
            counts.append((out.count(), len(substrings.EDGES.split(", "))))
        return out

    monkeypatch.setattr(substrings, "staged", counted)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.removed(docs_of(list(enumerate(texts)))).collect()}
    expected = [(r[1], r[3]) for r in brute.without_repeats(texts)]
    assert [got[i] for i in range(len(texts))] == expected
    # The first 300 windows of each text: far fewer rows than one for each.
    assert sum(n for n, _ in counts) < 10 * len(texts)


def test_null_and_repeated_ids_and_empty_tables(spark, docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "")]
    got = sorted(map(tuple, ngrams.near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, 2)], key=repr)
    assert ngrams.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    docs = docs_of([(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (None, "x y")])
    kept = ngrams.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"]) == [
        (-1, "x y"),
        (3, "a b c d e f"),
    ]
    assert kept.count() == 3


def test_repeats_are_those_of_brute_force(docs_of, hard_texts):
    rows = list(enumerate(hard_texts)) + [(1000 + i, hard_texts[10]) for i in range(40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.removed(docs_of(rows)).collect()}
    want = brute.without_repeats([t for _, t in rows])
    assert got == {i: w for (i, _), w in zip(rows, want)}


@pytest.mark.parametrize("length,trigger,most", [(20, 8, 32), (20, 20, 3), (21, 1, 2)])
def test_repeats_of_other_lengths(docs_of, length, trigger, most, monkeypatch):
    monkeypatch.setattr(substrings, "NEIGHBOURS", most)
    rng = random.Random(length + trigger)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["ab" * 300, "b" * 100, texts[0] * 3]
    got = {
        r["doc_id"]: tuple(r)[1:]
        for r in substrings.removed(docs_of(list(enumerate(texts))), length, trigger).collect()
    }
    assert got == dict(enumerate(brute.without_repeats(texts, length)))


def test_phrases_hold_every_window_once_in_any_chunks(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (5000, 10, 200, 199, 431)]
    monkeypatch.setattr(substrings, "CHUNK", 700)
    seen = []
    for parts, data, ends in substrings._chunks(texts, 200):
        begins = ends - np.diff(ends, prepend=0)
        start, n, *_ = substrings.phrases_of(data, ends)
        for s, k in zip(start.tolist(), n.tolist()):
            p = int(np.searchsorted(ends, s, side="right"))
            assert s + k - 1 + 200 <= ends[p]
            seen += [(parts[p][0], parts[p][1] + s - int(begins[p]) + i) for i in range(k)]
    assert sorted(seen) == [(i, a) for i, t in enumerate(texts) for a in range(len(t) - 199)]


def test_texts_without_repeats_keep_their_columns(docs_of):
    same = "é" * 150
    docs = docs_of([(1, same), (2, f"a{same}b"), (3, None), (4, "short")])
    done = substrings.without_repeats(docs)
    assert done.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {1: "", 2: "ab", 3: None, 4: "short"}


def near_vectors(n, dims, spread, rng):
    centre = rng.standard_normal(dims)
    return [centre + spread * rng.standard_normal(dims) for _ in range(n)]


def test_embedding_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dims in (64, 7):
        for label in (0, 1):
            for _ in range(12):
                for v in near_vectors(8, dims, rng.choice([0.02, 0.1, 0.14]), rng):
                    rows.append([len(rows), [float(x) for x in v], label])
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [[len(rows) + i, e, 0] for i, e in enumerate(odd)]
    rows.append([len(rows), rows[0][1], None])
    schema = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame(rows, schema).repartition(4).withColumn("row", F.lit(0)).withColumn("vec", F.lit(0))
    want = brute.vectors(rows)
    for tile in (2048, 5):  # with cells whole, and cut into tiles
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table, tile=tile).collect()}
        assert got == want
    assert sum(n > 0 for n, _ in want.values()) > 50
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_repeated_vectors_and_null_ids(spark):
    v = [1.0] * 8
    rows = [(4, v, 1), (4, v, 1), (None, v, 1), (None, None, 1), (2, [2.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(table).collect()), key=repr)
    assert got == sorted(
        [(4, 3, 2, False), (4, 3, 2, False), (None, 3, 2, False), (None, 0, None, False), (2, 3, 2, True)], key=repr
    )


def test_one_of_each_group_stays_whatever_tells_rows_apart(docs_of, hard_texts):
    plain = [(1000 - i, t) for i, t in enumerate(hard_texts)]
    components = brute.documents_by_shingles(plain)
    want = sorted(i for i, _ in plain if components[i][1] == i)
    docs = docs_of(plain).withColumn("_gone", F.lit(1))
    kept = ngrams.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want
    # A repeated row and one without an id: rows are numbered then.
    again = docs_of([*plain, plain[8], (None, plain[8][1]), (None, "only here, five words and more")])
    left = [r["doc_id"] for r in ngrams.one_of_each(again).select("doc_id").collect()]
    assert sorted(i for i in left if i is not None) == want and left.count(None) == 1
