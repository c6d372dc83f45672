"""Byte-level BPE encoding and decoding by replaying the merges over a corpus of pieces.

The distinct pieces that a task meets are laid out one after the other as one sequence of
byte tokens.  An inverted index leads from each possible merge to the positions where its
pair stands.  The merges are applied in rank order to all their positions at once; only the
neighbours of a merged pair change, and only their new pairs enter the index.  Merges never
cross a piece, so replaying each task's share of the corpus gives what a replay of the whole
would, and no vocabulary of the corpus has to meet in one place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from periodica.llm.common import text_batches, texts_of
from periodica.llm.pretokens import Pieces, encoded_texts

OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes lists of pieces with a rank file, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.known_pairs: dict[int, int] = {}
        self.byte_table = np.array(self.byte_ids)
        self.byte_pairs = np.array(
            [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        )

    def merged(self, left: int, right: int) -> int:
        """The rank, and id, of the token a pair makes; -1 if it makes none."""
        found = self.known_pairs.get(left << 20 | right)
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.known_pairs) > 1_000_000:
                self.known_pairs.clear()
            self.known_pairs[left << 20 | right] = found
        return found

    def encode_one(self, piece: bytes) -> list[int]:
        """One piece, one merge at a time: the leftmost pair of the lowest rank."""
        ids = [self.byte_ids[b] for b in piece]
        while len(ids) > 1:
            best = min(((r, i) for i in range(len(ids) - 1) if (r := self.merged(ids[i], ids[i + 1])) >= 0), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """All pieces at once.

        Should a merge make a pair of a lower rank than its own, which the replay has
        passed by, that piece is encoded by itself.
        """
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        # One sequence of tokens with links to the neighbours; -1 at the ends of a piece.
        following = np.arange(1, n + 1)
        following[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        symbols: list[int] = self.byte_table[data].tolist()
        first = np.where(following >= 0, self.byte_pairs[data, np.append(data[1:], 0)], -1)
        following, before = following.tolist(), before.tolist()
        # The inverted index: rank of a merge -> positions of its pair, leftmost first.
        by_rank = np.argsort(first, kind="stable")
        by_rank = by_rank[np.searchsorted(first[by_rank], 0) :]
        found = first[by_rank]
        borders = np.flatnonzero(np.diff(found)) + 1
        index: dict[int, list[int]] = {
            int(found[a]): by_rank[a:b].tolist()
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(found)])
            if b > a
        }
        heap = sorted(index)
        pair, merged, push = self.known_pairs.get, self.merged, heapq.heappush
        passed_by: list[int] = []
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            for i in places:
                left = symbols[i]
                j = following[i]
                if left < 0 or j < 0:
                    continue
                r = pair(left << 20 | symbols[j])
                if (merged(left, symbols[j]) if r is None else r) != rank:
                    continue
                symbols[i], symbols[j] = rank, -1
                after = following[i] = following[j]
                if after >= 0:
                    before[after] = i
                    r = pair(rank << 20 | symbols[after])
                    if r is None:
                        r = merged(rank, symbols[after])
                    if r > rank:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(heap, r)
                    elif r >= 0:
                        passed_by.append(i)
                at = before[i]
                if at >= 0:
                    r = pair(symbols[at] << 20 | rank)
                    if r is None:
                        r = merged(symbols[at], rank)
                    if r > rank:
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            push(heap, r)
                    elif r >= 0:
                        passed_by.append(i)
        left = np.array(symbols, dtype=np.int64)
        alive = left >= 0
        counts = np.cumsum(alive)[ends - 1].tolist()
        ids = left[alive].tolist()
        out = [ids[a:b] for a, b in zip([0, *counts[:-1]], counts)]
        for k in set(np.searchsorted(ends, passed_by, side="right").tolist()):
            out[k] = self.encode_one(raw[k])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_coders: dict[str, tuple[MergeReplay, Pieces]] = {}


def coder(path: str) -> tuple[MergeReplay, Pieces]:
    """The coder of a rank file; a worker keeps it between batches and tasks."""
    if path not in _coders:
        replay = MergeReplay(read_ranks(path))
        _coders[path] = replay, Pieces(replay.encode)
    return _coders[path]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with the token ids of every whole text.

    A null text counts as empty and has no ids; null and repeated keys are kept, one row in,
    one row out; other columns are dropped.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = coder(path)
        for batch in batches:
            held: list[np.ndarray] = []
            ids = []
            for _, part, last in encoded_texts(texts_of(batch), pieces):
                held.append(part)
                if last:
                    ids.append(np.concatenate(held).astype(np.int64))
                    held = []
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"]
            )

    text_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")
    return rows.mapInArrow(encode, "key long, ids array<long>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text encoded and decoded again: the digest columns of op5.

    Texts are taken in chunks of bounded size, so a very long one needs memory for a chunk
    and not for all its ids.  A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pieces = coder(path)
        for batch in batches:
            counts, ids_hashes, text_hashes = [], [], []
            count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for _, ids, last in encoded_texts(texts_of(batch), pieces):
                count += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                text_hash.update(replay.decode(ids.tolist()))
                if last:
                    counts.append(count)
                    ids_hashes.append(ids_hash.hexdigest())
                    text_hashes.append(text_hash.hexdigest())
                    count, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_hashes, pa.string()),
                    pa.array(text_hashes, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    text_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")
    return rows.mapInArrow(run, OUTPUT)
