"""Splitting texts into the pieces that byte-level BPE merges within, many texts at a time.

The split follows the public pattern of the tokenizer file: contractions; an optional
space with letters, numbers or other signs; white space, whose last character stays apart
from what precedes it when something follows.  It is computed on code-point arrays.  A
64-bit polynomial hash brings pieces together that may be equal; each is then compared with
the first of its hash, and where one differs, the pieces themselves are sorted out.  So each
distinct piece is encoded once per worker, and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The contractions of the pattern, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

CHUNK_CHARS = 1 << 21
KNOWN_PIECES = 800_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            table[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    return table


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_power_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache.get("up", ())) < n:
        _power_cache["up"], _power_cache["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _power_cache["up"][:n], _power_cache["down"][:n]


def cuts(text: str, limit: int) -> Iterator[str]:
    """A long text in parts; each cut is before a single space between other characters,
    where a piece begins whatever surrounds it."""
    start, place = 0, regex.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > limit:
        found = place.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points that begin a piece; first: where the (non-empty) texts begin."""
    kind = classes()[points]
    n = len(points)
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    opens[n] = True
    space = kind == SPACE
    inside = ~opens[:n]  # has a predecessor in its text
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = space[:-1]
    after_space &= inside
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = points[:-1] == 0x20
    changed = np.ones(n, dtype=bool)
    changed[1:] = kind[1:] != kind[:-1]
    before_other = np.zeros(n, dtype=bool)
    before_other[:-1] = ~space[1:]
    before_other &= ~opens[1:]
    begin = np.where(
        space,
        ~after_space | before_other,
        ~inside | (after_space & ~after_blank) | (~after_space & changed),
    )
    for i in np.flatnonzero((points == 0x27) & begin).tolist():
        for tail in CONTRACTIONS:
            end = i + 1 + len(tail)
            if end <= n and not opens[i + 1 : end].any() and points[i + 1 : end].tolist() == [*map(ord, tail)]:
                begin[i + 1 : end] = False
                if end < n and not space[end]:
                    begin[end] = True
                break
    return begin


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key the number of its group, and for every group its first member."""
    inverse, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), dtype=np.int64)
    first[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return inverse, first


def _same(points: np.ndarray, at: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether every piece points[at:stop] equals the one whose number is in `other`."""
    sizes = stop - at
    if (sizes != sizes[other]).any():
        return False
    differ = np.flatnonzero(other != np.arange(len(at)))
    sizes = sizes[differ]
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, first = np.repeat(at[differ], sizes), np.repeat(at[other[differ]], sizes)
    return bool((points[own + step] == points[first + step]).all())


class Pieces:
    """Encoded pieces of one worker; forgets all when it holds too many."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = KNOWN_PIECES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _add(self, pieces: list[str], encoded: list[list[int]]) -> None:
        n, m = len(self.slots), len(pieces)
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=m)
        flat = np.fromiter((x for e in encoded for x in e), dtype=np.uint32, count=int(sizes.sum()))
        while n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.slots.update(zip(pieces, range(n, n + m)))

    def encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lengths)
        first = (ends - lengths)[lengths > 0]
        at = np.flatnonzero(piece_starts(points, first))
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        stop = np.append(at[1:], len(points))
        hashes = (sums[stop] - sums[at]) * down[at]
        inverse, place = _firsts(hashes)
        if not _same(points, at, stop, place[inverse]):
            pieces = np.array([joined[a:b] for a, b in zip(at.tolist(), stop.tolist())], dtype=object)
            inverse, place = _firsts(pieces)
        if len(self.slots) > self.limit:
            self.clear()
        keys = [joined[a:b] for a, b in zip(at[place].tolist(), stop[place].tolist())]
        get = self.slots.get
        slots = np.fromiter((get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            unknown = [keys[k] for k in new.tolist()]
            encoded = self.encode(unknown)
            slots[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self._add(unknown, encoded)
        used = slots[inverse]
        sizes = self.sizes[used]
        total = np.cumsum(sizes)
        index = np.repeat(self.starts[used] - (total - sizes), sizes) + np.arange(int(total[-1]))
        ids = self.ids[index]
        pieces_before = np.searchsorted(at, ends, side="left")
        ends_in_ids = np.where(pieces_before > 0, total[pieces_before - 1], 0)
        return np.split(ids, ends_in_ids[:-1])


def encoded_texts(
    texts: Iterable[str], pieces: Pieces, chunk: int | None = None
) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(index of the text, ids, whether the text ends here), in order, in bounded chunks."""
    chunk = chunk or CHUNK_CHARS
    parts: list[str] = []
    owners: list[tuple[int, bool]] = []
    held = 0

    def flush():
        for (i, last), ids in zip(owners, pieces.encode_chunk(parts)):
            yield i, ids, last

    for i, text in enumerate(texts):
        split = list(cuts(text, chunk)) if len(text) > chunk else [text]
        for k, part in enumerate(split):
            if parts and held + len(part) > chunk:
                yield from flush()
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append((i, k == len(split) - 1))
            held += len(part)
    if parts:
        yield from flush()
