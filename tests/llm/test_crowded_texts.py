"""Texts with very many findings: the same results, in time that grows with the text."""

import random

from periodica.llm import pii
from tests.llm import brute


def redacted(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{pii.KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_random_texts_as_found_and_replaced_one_by_one(docs_of):
    rng = random.Random(5)
    parts = ["a@b.c", "1.2.3.4", "+1 (555) 010-1234", "555-010-4242", "4111 1111 1111 1111", "é", "🙂" * 700]
    parts += [" ", "\n", "x" * 900, "+14111111111111111", "q@1.2.3.4", "8-8-8-8-8-8-8", "call me at "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice((3, 30, 400)))) for _ in range(60)]
    texts += ["a@b.c " * 1500, "é" * 4096 + "a@b.c", "é" * 4095 + " a@b.c", "a@b.c" + "🙂" * 8192]
    rows = docs_of(list(enumerate(texts)))
    based = pii.with_base(rows).select("doc_id", "base", "candidates", "text")
    seen = based.select("*", pii.redacted("text", "base").alias("done")).collect()
    assert len(seen) == len(texts)
    for r in seen:
        base = [(s["start"], s["kind"], s["end"]) for s in r["base"]]
        assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base) == brute.spans_text(brute.base_spans(r["text"]))
        assert r["done"] == redacted(r["text"], base)
        places = [(c["start"], c["end"]) for c in r["candidates"]]
        assert all(r["text"][a:b] == c["value"] for (a, b), c in zip(places, r["candidates"]))
        overlap = [1 for a, b in places for s, _, e in base if s < b and a < e]
        assert not overlap and places == sorted(places)
        every = {(m.start(), m.end()) for m in brute_candidates(r["text"])}
        free = {(a, b) for a, b in every if not any(s < b and a < e for s, _, e in base)}
        assert set(places) == free


def brute_candidates(text):
    import regex

    pattern = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|\G[^\s@]++@[^\s@]++|(?<![^\s@])[^\s@]++@[^\s@]++"
    return regex.finditer(pattern, text)


def test_a_hundred_thousand_addresses_in_one_text(docs_of):
    text = " ".join(f"user{i}@example.com" for i in range(100_000))
    dots = "1.2" * 331_999  # 332,000 numbers, four to an address
    rows = pii.redacted_documents(docs_of([(1, text), (2, dots)])).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[1] == " ".join(["<EMAIL>"] * 100_000)
    assert got[2] == ".".join(["<IP>"] * 83_000)
