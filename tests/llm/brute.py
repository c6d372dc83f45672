"""Plain, slow versions of the operators, written from their contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def vectors(rows, cosine=0.98):
    """rows: (vec_id, embedding, label) with distinct ids -> {vec_id: (n_links, component)}."""
    usable = defaultdict(list)
    for i, e, label in rows:
        if label is None or not e or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            continue
        x = np.array(e, dtype=np.float32).astype(np.float64)
        usable[label, len(x)].append((i, x / np.sqrt((x * x).sum())))
    links = []
    for group in usable.values():
        m = np.array([x for _, x in group])
        for p, q in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1))):
            links.append((group[p][0], group[q][0]))
    counts = Counter(i for pair in links for i in pair)
    reach = smallest_reachable([r[0] for r in rows], links)
    return {r[0]: (counts[r[0]], reach[r[0]]) for r in rows}


def shingle_set(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def documents_by_shingles(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component)}."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    links = [
        (a, b)
        for (a, b), n in common.items()
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)
    ]
    reach = smallest_reachable(sets, links)
    return {i: (len(s), reach[i]) for i, s in sets.items()}


def without_repeats(texts, length=200):
    """[(n_bytes, n_removed, n_spans, sha256 of the rest)] for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter()
    for r in raw:
        seen.update(hash(r[i : i + length]) for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[hash(r[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


KINDS = ("email", "ip", "card", "phone")
FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def base_spans(text):
    """(start, kind number, end) in order."""
    return sorted(
        (m.start(), k, m.end())
        for k, kind in enumerate(KINDS)
        for m in re.finditer(FIXED[kind], text or "")
        if holds(kind, m[0])
    )


def spans_text(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
