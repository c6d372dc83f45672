"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Documents are tokenized and cut into pieces.  Pieces of one length are interchangeable, so
the packing is decided for lengths: a histogram, whose size depends on the capacity and not
on the documents, stands for the range-sorted pieces, and runs of equal sequences for the
range-sorted gaps.  In each round a sweep from the largest value down gives every piece the
smallest gap that holds it; where several pieces want a gap, the larger one and then the
lower rank has it.  A gap takes one piece a round; then the gaps are updated and the next
round begins.  A round is for the longest pieces that are left, so that short ones do not
take the gaps that long ones need.  What a sweep decides are intervals of ranks, and every piece finds its place
by its own rank, in its own task.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from periodica.llm.common import staged, text_batches, texts_of
from periodica.llm.pretokens import Pieces, encoded_texts

END_ID = 0
CAPACITY = 2048
SALTS = 32
# A round takes the pieces longer than this part of the longest that is left.
BAND = 0.97
# A worker keeps what it has encoded when its task ends, and an executor has several workers
# beside its heap: the texts, the pieces known and those encoded at once are bounded for that.
CHUNK_CHARS = 1 << 19
KNOWN_PIECES = 300_000
ENCODED_AT_ONCE = 10_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64())]
)


@cache
def settled() -> np.ndarray:
    """Code points whose kind is the same in old and new versions of Unicode.

    The library may know an older version than this process; a text with other code points
    is left whole to the library.
    """
    old, out = unicodedata.ucd_3_2_0, np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = kind[0] == old.category(c)[0] and kind != "Cn"
    return out


_coders: dict[str, tuple[object, Pieces]] = {}


def coder(path: str):
    if path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def encode(pieces: list[str]) -> list[list[int]]:
            ids: list[list[int]] = []
            for k in range(0, len(pieces), ENCODED_AT_ONCE):
                some = tokenizer.encode_batch(pieces[k : k + ENCODED_AT_ONCE], add_special_tokens=False)
                ids.extend(e.ids for e in some)
            return ids

        _coders[path] = tokenizer, Pieces(encode, KNOWN_PIECES)
    return _coders[path]


def _encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text, in order."""
    tokenizer, pieces = coder(path)
    ok, plain = settled(), []
    for t in texts:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        plain.append(t.isascii() or bool(ok[points].all()))
    own = encoded_texts([t for t, p in zip(texts, plain) if p], pieces, CHUNK_CHARS)
    for text, p in zip(texts, plain):
        if not p:
            yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            continue
        parts = []
        for _, ids, last in own:
            parts.append(ids)
            if last:
                break
        yield np.concatenate(parts)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of every document: its ids and an end id, cut from the back.

    A null text counts as empty and is one piece of the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("key").to_pylist(), _encoded(texts_of(batch), path)):
                ids = np.append(ids, END_ID).astype("<u4")
                data = ids.tobytes()
                at = 0
                first = len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((doc, k, at, end - at, zlib.crc32(data[4 * at : 4 * end])))
                    at = end
            columns = zip(*rows) if rows else [[]] * len(ARROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW
            )

    text_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{key}` as bigint) as key", f"`{text}` as text")
    return rows.mapInArrow(run, PIECE)


def sweeps(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, count, first sequence, offset) runs, and the number of sequences.

    Pieces of `length` with ranks from `first rank` go to sequences from `first sequence`,
    one each, at `offset`.
    """
    left = {s: n for s, n in sizes.items() if n}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0
    while left:
        # The pieces of this round: the largest that are left, and those near them.
        largest = max(left)
        band = {s for s in left if s > BAND * largest}
        stack: list[list[int]] = []  # gap, first sequence, count; the smallest on top
        changed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        stuck = True
        for value in sorted(band | gaps.keys(), reverse=True):
            stack.extend([value, a, n] for a, n in reversed(gaps.get(value, ())))
            n = left[value] if value in band else 0
            while n and stack:
                gap, a, room = stack[-1]
                k = min(n, room)
                runs.append((value, rank[value], k, a, capacity - gap))
                rank[value] += k
                n -= k
                stuck = False
                if gap > value:
                    changed[gap - value].append((a, k))
                if k == room:
                    stack.pop()
                else:
                    stack[-1][1:] = [a + k, room - k]
            if value in band:
                if n:
                    left[value] = n
                else:
                    left.pop(value)
        for gap, a, n in stack:
            changed[gap].append((a, n))
        gaps = changed
        if stuck:  # no gap holds any of them: new sequences, as many as they fill
            need = -(-sum(left[s] for s in band) // (capacity // largest))
            gaps.setdefault(capacity, []).append((made, need))
            made += need
    return runs, made


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Pieces with the sequence and the place that each is given.

    pieces: doc_id, piece, start, length and any other columns; lengths from 1 to capacity.
    A sequence holds at most capacity tokens, without gaps from 0.  A piece as long as a
    sequence has one of its own.  Null and repeated ids are rows like any other, and an
    empty table gives an empty one.  Stages the pieces, and reads a histogram of at most
    capacity x salts rows to the driver.
    """
    known = staged(
        pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces"
    )  # written once, so that rows keep their number
    known = known.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    short = known.where(F.col("length") < capacity)
    counted = short.groupBy("length", "_salt").count().orderBy("length", "_salt").collect()
    before = np.zeros((capacity, salts), dtype=np.int64)
    sizes: dict[int, int] = defaultdict(int)
    for length, salt, n in counted:
        before[length, salt] = sizes[length]
        sizes[length] += n
    runs, made = sweeps(sizes, capacity)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)

    ranked = short.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = before[length, batch["_salt"].to_numpy()] + batch["_rank"].to_numpy()
            run = table[np.searchsorted(starts, (length << 44) | rank, side="right") - 1]
            batch["sequence_id"] = run[:, 3] + rank - run[:, 1]
            batch["offset"] = run[:, 4]
            yield batch[names]

    columns = [f for f in known.schema if f.name not in ("_row", "_salt")]
    names = [f.name for f in columns] + ["sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    placed = ranked.mapInPandas(place, schema + ", sequence_id long, offset long")
    whole = known.where(F.col("length") >= capacity)
    return placed.unionByName(
        whole.select(
            *[f.name for f in columns],
            (F.col("_row") + F.lit(made)).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
