"""Masked CRC-32C checksums of many byte strings at once.

A message is cut into lanes of equal length, with zeros before its first byte, which leave a
checksum that begins at zero as it is.  All lanes go through the tables together, 8 bytes a
step, and a message's lanes are then folded from the first to the last.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# The Castagnoli polynomial (reflected) and the mask of record files.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
LANE = 256


@cache
def _tables() -> list[np.ndarray]:
    """For j = 0 to 3: the checksums of two bytes that 2 j zero bytes follow."""
    value = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    tables = [value]
    for _ in range(3):
        last = tables[-1]
        tables.append(tables[0][last & 0xFFFF] ^ (last >> 16))
    return tables


def _steps(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The state of each row after the 16-bit words of its columns, four at a time."""
    t0, t1, t2, t3 = _tables()
    for k in range(0, words.shape[1], 4):
        state = (
            t3[words[:, k] ^ (state & 0xFFFF)]
            ^ t2[words[:, k + 1] ^ (state >> 16)]
            ^ t1[words[:, k + 2]]
            ^ t0[words[:, k + 3]]
        )
    return state


@cache
def _shift() -> tuple[np.ndarray, np.ndarray]:
    """What a lane of zero bytes makes of the low and the high half of a state."""
    zeros = np.zeros((1 << 16, LANE // 2), dtype=np.uint16)
    low = np.arange(1 << 16, dtype=np.uint32)
    return _steps(low, zeros), _steps(low << np.uint32(16), zeros)


def masked_checksums(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The masked checksum of each message; data: the bytes of all, one after the other.

    Every message has at least 4 bytes.
    """
    sizes = sizes.astype(np.int64)
    lanes = -(-sizes // LANE)
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(lanes) - lanes
    # Zeros in front; then every message ends where its last lane does.
    padded = np.zeros(int(lanes.sum()) * LANE, dtype=np.uint8)
    at = (first + lanes) * LANE - sizes
    padded[np.arange(len(data)) + np.repeat(at - starts, sizes)] = data
    for k in range(4):  # the state begins as all ones
        padded[at + k] ^= 0xFF
    each = _steps(np.zeros(int(lanes.sum()), dtype=np.uint32), padded.view("<u2").reshape(-1, LANE // 2))
    low, high = _shift()
    order = np.argsort(-lanes, kind="stable")
    fold = np.zeros(len(sizes), dtype=np.uint32)
    begin, many = first[order], lanes[order]
    for k in range(int(many[0]) if len(many) else 0):
        n = int(np.searchsorted(-many, -k, side="left"))  # those with more than k lanes
        state = fold[:n]
        fold[:n] = low[state & 0xFFFF] ^ high[state >> 16] ^ each[begin[:n] + k]
    out = np.empty(len(sizes), dtype=np.uint32)
    out[order] = ~fold
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)
