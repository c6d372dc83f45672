import hashlib
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from periodica.llm import periods
from tests.llm.brute import WORD

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


def plain_runs(words, least=24, times=3):
    """All maximal stretches of every period, then those of a smaller period taken out."""
    found = {}
    for q in range(1, len(words) // times + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                if i - start + q >= max(least, times * q) and (start, i + q) not in found:
                    found[start, i + q] = q
                start = i + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_digest(doc, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    gone = {i for a, b, q in runs for i in range(a + q, a + b)}
    return (
        len(runs),
        *(best[0] if best else (None,) * 3),
        int(1000 * best[0][1] // best[0][2]) if best else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        text = []
        while len(text) < 90:
            block = [rng.randrange(rng.choice((2, 3, 9))) for _ in range(rng.randrange(1, 12))]
            text += block * rng.randrange(1, 6) + block[: rng.randrange(len(block))]
        texts.append(np.array(text[: rng.randrange(100)], dtype=np.int64))
    for least in (3, 8, 24):
        assert periods.runs_of(texts, least) == [plain_runs(t.tolist(), least) for t in texts]
    assert [periods.runs_of([t], 6)[0] for t in texts] == periods.runs_of(texts, 6)
    assert periods.runs_of([]) == [] and periods.runs_of(texts[:0]) == []
    with pytest.raises(ValueError):
        periods.runs_of(texts, 8, times=2)


def test_fixed_runs():
    def runs(text):
        return periods.runs_of(periods._numbers([text.encode()]))[0]

    assert runs("a " * 24) == [(0, 24, 1)]
    assert runs("a " * 23) == []
    assert runs("x " + "a b c " * 8 + "a b y") == [(1, 26, 3)]
    assert runs(" ".join(f"w{i % 20}" for i in range(60))) == [(0, 60, 20)]
    assert runs(" ".join(f"w{i % 20}" for i in range(59))) == []
    assert runs("a b " * 12 + "a " * 30) == [(0, 25, 2), (24, 30, 1)]


def cases(hard_texts):
    rng = random.Random(9)
    texts = [*hard_texts, "a " * 900, "a\tb\n" * 40, " ".join(f"w{rng.randrange(2)}" for _ in range(900))]
    passage = " ".join(f"w{k}" for k in range(50))
    texts += [f"{passage} " * k for k in (2, 3, 4, 40)] + ["ñ 日本 🙂 x " * 30]
    # Ids whose documents get a planted tail, and others; repeated rows and null ids.
    rows = list(enumerate(texts)) + [(i, texts[i % len(texts)]) for i in range(1000, 1400)]
    return rows + rows[:3] + [(None, passage), (None, None), (-7, passage)]


def test_digests_equal_brute_force(docs_of, hard_texts):
    rows = [r for r in cases(hard_texts) if len(r[1] or "") < 6_000]
    got = periods.run_digests(periods.with_planted_runs(docs_of(rows))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_digest(i, t))) for i, t in rows)
    assert periods.run_digests(periods.with_planted_runs(docs_of(rows).limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want = {(r["doc_id"], *plain_digest(r["doc_id"], r["text"])) for r in docs.collect() if len(r["text"] or "") < 5_000}
    got = {tuple(r) for r in entry.queries()["op11_basic_factors"](spark, FOLDER).collect()}
    assert want <= got and len(got) == docs.count()


def test_run_rows_and_collapsed_documents(docs_of, hard_texts):
    rows = [r for r in cases(hard_texts) if len(r[1] or "") < 6_000]
    runs = {tuple(r) for r in periods.periodic_runs(docs_of(rows)).collect()}
    assert runs == {(i, *r) for i, t in rows for r in plain_runs(WORD.findall(t or ""))}
    docs = docs_of(rows)
    done = periods.collapsed(docs)
    assert done.columns == docs.columns and done.schema["text"].dataType == docs.schema["text"].dataType
    got = sorted((repr((r["doc_id"], r["text"], r["kept"], r["lang"])) for r in done.collect()))

    def plain(text):
        words = WORD.findall(text or "")
        gone = {i for a, b, q in plain_runs(words) for i in range(a + q, a + b)}
        return " ".join(w for i, w in enumerate(words) if i not in gone) if gone else text

    assert got == sorted(repr((i, plain(t), "x", "en")) for i, t in rows)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = "one two three " * 40 + "four " * 3
    whole = list(periods._judged([text, "a " * 30], 24, 3))
    monkeypatch.setattr(periods, "CHUNK", 50)
    assert list(periods._judged([text, "a " * 30], 24, 3)) == whole
    assert list(periods._kept(*[(r, x, n) for r, n, x in whole][0])) == b"one two three four four four".split()


def test_a_long_periodic_text_takes_no_time():
    text = np.tile(np.arange(1000), 500)
    assert periods.runs_of([text]) == [[(0, 500_000, 1000)]]
    assert periods.runs_of([np.zeros(1_000_000, dtype=np.int64)]) == [[(0, 1_000_000, 1)]]
