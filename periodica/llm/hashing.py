"""64-bit hashes of byte strings, computed for many places of an array at once.

A string's hash is a polynomial of its bytes modulo 2^64 with an odd base, taken from prefix
sums, and then mixed by a bijection.  It is for strings of up to some hundred bytes: among
longer ones there are texts of two letters that collide whatever the base is (the Thue-Morse
word of 1,024 letters and its complement).
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["up"][:n], _tables["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """sums, such that hashes(sums, a, b) is the hash of values[a:b]."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible order."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
