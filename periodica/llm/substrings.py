"""Removal of every byte string of a given length that occurs twice, by prefix-free parsing.

Parse.  A rolling hash of short strings sets triggers: the trigger of a window of `length`
bytes is the smallest hash inside it (the leftmost of equal ones), which the bytes of the
window alone decide, so equal windows have equal triggers at equal places, and no window is
without one.  Neighbouring windows with one trigger make a phrase; phrases overlap, and
together hold every window once.

Order.  Only strings that agree for `length` bytes matter, so the suffix orders of parse and
dictionary are cut there, and equality of hashes stands for neighbourhood in the order.
First the parse: phrases with a trigger of their own hold nothing twice; of equal phrases
every window occurs twice.  Then the dictionary, for triggers that stand in different
phrases: one copy of each such phrase is opened, and compared with the others by the bytes
on both sides of the trigger.  Of a trigger with many phrases each is compared with the most
frequent one alone; the windows it has otherwise hold the nearest byte that differs, so the
string from the trigger to that byte brings them to those they can be equal to, turn by turn.
Long repeats are settled as phrases, and bytes are looked at only near their ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from periodica.llm.common import put_back, set_aside, staged, text_batches, text_or_empty
from periodica.llm.hashing import hashes, mixed, prefix_sums

LENGTH = 200
TRIGGER = 100
CHUNK = 1 << 20
PLACE_BITS = 24

FIGURES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
# Phrases of one trigger that are compared two by two.
NEIGHBOURS = 32
# Phrases of a crowded trigger that are compared with its centre at once.
STEP = 10_000
# Turns in which phrases of crowded triggers are told apart; what is crowded then goes by windows.
TURNS = 6
PHRASES = "text_id long, start int, n int, place int, trigger long, phrase long, copies int"


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours, by running minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases_of(data: bytes, ends: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(start, windows, place of the trigger, its hash, phrase hash) of the phrases of joined texts that end at
    `ends`; no window crosses an end."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(np.frombuffer(data, dtype=np.uint8))
    at = np.arange(len(data) - trigger + 1)
    grams = mixed(hashes(sums, at, at + trigger))
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = _minima((grams & ~low) | at.astype(np.uint64), length - trigger + 1)
    best = (best & low).astype(np.int64)
    windows = len(best)  # one for each start
    valid = np.ones(windows + 1, dtype=bool)
    valid[windows] = False
    for end in ends[:-1]:
        valid[max(0, end - length + 1) : end] = False
    opens = valid[:-1].copy()
    opens[1:] &= ~valid[:-2] | (best[1:] != best[:-1])
    closes = valid[:-1].copy()
    closes[:-1] &= ~valid[1:-1] | (best[1:] != best[:-1])
    start, last = np.flatnonzero(opens), np.flatnonzero(closes)
    n, place = last - start + 1, best[start]
    shape = ((place - start).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
    phrase = mixed(hashes(sums, start, last + length) ^ mixed(shape))
    return start, n, place - start, grams[place], phrase


def _chunks(texts: Iterable[str], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """((text, offset) of each part, joined parts, their ends); parts of one text overlap so
    that each of its windows is in one part."""
    parts: list[tuple[int, int]] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[at : at + CHUNK + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > CHUNK + length and held:
                yield parts, b"".join(held), np.cumsum([len(h) for h in held])
                parts, held, size = [], [], 0
            parts.append((i, at))
            held.append(part)
            size += len(part)
    if held:
        yield parts, b"".join(held), np.cumsum([len(h) for h in held])


def parsed(texts: DataFrame, length: int, trigger: int) -> DataFrame:
    """The phrases of texts (text_id, text); equal texts of a batch once, with their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            copies = batch["text_id"].value_counts()
            once = batch.drop_duplicates("text_id")
            ids = once["text_id"].to_numpy()
            counts = copies.loc[ids].to_numpy()
            for parts, data, ends in _chunks(once["text"], length):
                start, n, place, gram, phrase = phrases_of(data, ends, length, trigger)
                part = np.searchsorted(ends, start, side="right")
                begins = ends - np.diff(ends, prepend=0)
                owner = np.array([p[0] for p in parts])[part]
                offset = np.array([p[1] for p in parts])[part]
                yield pd.DataFrame(
                    {
                        "text_id": ids[owner],
                        "start": (start - begins[part] + offset).astype(np.int32),
                        "n": n.astype(np.int32),
                        "place": place.astype(np.int32),
                        "trigger": gram.view(np.int64),
                        "phrase": phrase.view(np.int64),
                        "copies": counts[owner].astype(np.int32),
                    }
                )

    return texts.select("text_id", "text").mapInPandas(run, PHRASES)


EDGES = "trigger long, text_id long, start int, n int, place int, wanted boolean, bytes binary"
_EDGES = [c.split()[0] for c in EDGES.split(", ")]


def _opened(edges: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases in `runs` of a text, with the place of the trigger in them.

    Of equal texts in a task the first is opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            text_ids = batch.column("text_id").to_pylist()
            lists = batch.column("runs")
            offsets = lists.offsets.to_numpy()
            parts = {f: lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n")}
            for i, text_id in enumerate(text_ids):
                if text_id in seen:
                    continue
                seen.add(text_id)
                rows = slice(offsets[i], offsets[i + 1])
                text = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                raw = [text[a : a + k + length - 1] for a, k in zip(parts["start"][rows].tolist(), parts["n"][rows].tolist())]
                own = lists.values.slice(offsets[i], offsets[i + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        own.field("trigger"),
                        pa.array(np.full(len(raw), text_id)),
                        own.field("start"),
                        own.field("n"),
                        own.field("place"),
                        own.field("wanted"),
                        pa.array(raw, pa.binary()),
                    ],
                    _EDGES,
                )

    columns = ["text_id", "text", "doc_id", "runs"]
    return edges.select(*columns).mapInArrow(run, EDGES)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one after the other, and where each value begins."""
    raw = pa.concat_arrays(column.chunks)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def _extents(rows: pa.Table, p: np.ndarray, q: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray]:
    """How many equal bytes the phrases p and q have left and right of their trigger."""
    side = length - trigger
    place = rows.column("place").to_numpy()
    data, starts = _binary(rows.column("bytes"))
    step = np.arange(side)

    def equal(first: np.ndarray, way: int, room: np.ndarray) -> np.ndarray:
        most = np.minimum(room[p], room[q])
        within = step[None, :] < most[:, None]
        at = [np.where(within, first[x][:, None] + way * step[None, :], 0) for x in (p, q)]
        same = (data[at[0]] == data[at[1]]) & within
        return np.where(same.all(axis=1), side, same.argmin(axis=1)) if side else np.zeros(len(p), int)

    middle = starts[:-1] + place
    left = equal(middle - 1, -1, place)
    right = equal(middle + trigger, 1, starts[1:] - middle - trigger)
    return left, right


FOUND = "hash long, text_id long, start int, n int"


def _runs(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated windows, as rows of edges without a trigger."""
    none = [pa.nulls(len(ids), k) for k in (pa.int64(), pa.int32(), pa.bool_(), pa.binary())]
    columns = [none[0], pa.array(ids), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *none[1:]]
    return pa.RecordBatch.from_arrays(columns, _EDGES)


def _parted(table: pa.Table, length: int, trigger: int) -> Iterator[pa.RecordBatch]:
    """Phrases of one trigger against the first of them, the centre.

    Windows that are equal to the centre's are repeated.  Of the others those that reach over
    the first byte on the left that differs (or that one of the two has not) can be equal
    only to windows of phrases that differ from the centre at the same place, and that have
    the same bytes from there to the end of the trigger.  They make an edge whose trigger is
    the hash of these bytes; windows that reach over the first such byte on the right alone
    make another one.
    """
    side = length - trigger
    ids, start, n, place = (table.column(c).to_numpy() for c in ("text_id", "start", "n", "place"))
    wanted = table.column("wanted").to_numpy(zero_copy_only=False)
    rows = np.arange(1, len(n))
    left, right = _extents(table, np.zeros(len(rows), dtype=np.int64), rows, length, trigger)
    # Windows before `low` reach over the left byte; those from `high` on over the right one alone.
    low = np.clip(place[rows] - left, 0, n[rows])
    high = np.clip(place[rows] + right - side + 1, low, n[rows])
    some = (high > low) & wanted[rows]
    if some.any():
        yield _runs(ids[rows][some], (start[rows] + low)[some], (high - low)[some])
    if wanted[0] and (high > low).any():  # the same windows, at the centre's place for them
        to_centre = place[0] - place[rows]
        edges = np.zeros(n[0] + 1, dtype=np.int64)
        np.add.at(edges, (low + to_centre)[high > low], 1)
        np.add.at(edges, (high + to_centre)[high > low], -1)
        turns = np.diff(np.pad(np.cumsum(edges) > 0, (1, 0)).astype(np.int8))
        first, last = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        yield _runs(np.full(len(first), ids[0]), start[0] + first, last - first)
    data, offsets = _binary(table.column("bytes"))
    raw, sums = data.tobytes(), prefix_sums(data)
    middle = offsets[:-1][rows] + place[rows]
    parts = (
        (low > 0, middle - left - 1, middle + trigger, np.zeros(len(rows), dtype=np.int64), low, left),
        (n[rows] > high, middle, middle + trigger + right + 1, high, n[rows], side + 1 + right),
    )
    for there, a, b, first, last, what in parts:
        x = np.flatnonzero(there)
        if not len(x):
            continue
        key = mixed(hashes(sums, a[x], b[x]) ^ mixed(what[x].astype(np.uint64)))
        begin = offsets[:-1][rows[x]]
        own = [raw[p:q] for p, q in zip(begin + first[x], begin + last[x] + length - 1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)),
                pa.array(ids[rows[x]]),
                pa.array((start[rows[x]] + first[x]).astype(np.int32)),
                pa.array((last - first)[x].astype(np.int32)),
                pa.array((place[rows[x]] - first[x]).astype(np.int32)),
                pa.array(wanted[rows[x]]),
                pa.array(own, pa.binary()),
            ],
            _EDGES,
        )


def _compared(edges: DataFrame, length: int, trigger: int) -> DataFrame:
    """The repeated windows of opened phrases, as runs without a trigger, and smaller edges.

    Phrases of one trigger stand beside each other.  Up to `NEIGHBOURS` of them are compared
    two by two by the bytes around the trigger, and give the runs of windows that both have.
    The phrases of a trigger with more are not held, but for the first one: the others are
    compared with that, and what they have otherwise comes out as edges to be compared again.
    """

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All of these triggers' phrases are in the table, sorted by trigger."""
        key = table.column("trigger").to_numpy()
        wanted = table.column("wanted").to_numpy()
        ids, start, place = (table.column(c).to_numpy() for c in ("text_id", "start", "place"))
        n, side = len(key), length - trigger
        # For each phrase, where runs of repeated windows begin (+1) and end (-1).
        edges = np.zeros((n, side + 2), dtype=np.int32)
        for gap in range(1, NEIGHBOURS):
            p = np.flatnonzero(key[: n - gap] == key[gap:]) if n > gap else np.zeros(0, int)
            if not len(p):
                break
            p = p[wanted[p] | wanted[p + gap]]
            for k in range(0, len(p), 10_000):
                a = p[k : k + 10_000]
                left, right = _extents(table, a, a + gap, length, trigger)
                some = left + right >= side
                a, left, right = a[some], left[some], right[some]
                for x in (a, a + gap):
                    np.add.at(edges, (x, place[x] - left), 1)
                    np.add.at(edges, (x, place[x] + right - side + 1), -1)
        inside = (np.cumsum(edges, axis=1) > 0) & wanted[:, None]
        turns = np.diff(np.pad(inside, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        row, first = np.nonzero(turns == 1)
        last = np.nonzero(turns == -1)[1]
        if len(row):
            yield _runs(ids[row], start[row] + first, last - first)

    def crowd(table: pa.Table, centre: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Phrases of one trigger; its centre if that is not their first one."""
        table = (pa.concat_tables([centre, table]) if centre is not None else table).combine_chunks()
        for at in range(1, table.num_rows, STEP):
            part = pa.concat_tables([table.slice(0, 1), table.slice(at, STEP)])
            yield from _parted(part.combine_chunks(), length, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the last trigger, at most NEIGHBOURS
        crowded = centre = None  # a trigger with more, and its first row
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            key = table.column("trigger").to_numpy()
            if crowded is not None:
                same = int(np.searchsorted(key != crowded, True)) if (key != crowded).any() else len(key)
                if same:
                    yield from crowd(table.slice(0, same), centre)
                table = table.slice(same)
                if not table.num_rows:
                    continue
                crowded = None
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            key = table.column("trigger").to_numpy()
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(edge, len(key)))
            large = np.repeat(size > NEIGHBOURS, size)
            last = np.arange(len(key)) >= edge[-1]
            if large[-1]:
                crowded, centre = key[-1], table.slice(edge[-1], 1)
            held = table.filter(pa.array(last & ~large)) if not large[-1] else None
            yield from pairs(table.filter(pa.array(~large & ~last)))
            for k in np.flatnonzero(size > NEIGHBOURS).tolist():
                yield from crowd(table.slice(edge[k], size[k]), None)
        if held is not None:
            yield from pairs(held)

    # Phrases that occur several times come first; among these and the others any may.
    dealt = edges.repartition("trigger").sortWithinPartitions("trigger", "wanted")
    return dealt.mapInArrow(run, EDGES)


def _by_window(edges: DataFrame, length: int) -> DataFrame:
    """The windows of phrases one by one, by hash, for the shuffle to bring equal ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from windows(pa.Table.from_batches([batch]))

    def windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, start, n = (table.column(c).to_numpy() for c in ("text_id", "start", "n"))
        data, offsets = _binary(table.column("bytes"))
        own = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        sums = prefix_sums(data)
        found = mixed(hashes(sums, offsets[own] + at, offsets[own] + at + length))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found.view(np.int64)),
                pa.array(ids[own]),
                pa.array((start[own] + at).astype(np.int32)),
                pa.array(np.ones(len(own), dtype=np.int32)),
            ],
            ["hash", "text_id", "start", "n"],
        )

    found = edges.mapInArrow(run, FOUND)
    same = Window.partitionBy("hash")
    return found.withColumn("total", F.count(F.lit(1)).over(same)).where("total > 1")


def _repeated(edges: DataFrame, length: int, trigger: int) -> DataFrame:
    """(text_id, start, n): the runs of repeated windows of opened phrases."""
    runs = None
    for _ in range(TURNS):
        found = staged(_compared(edges, length, trigger), "found")
        now = found.where("trigger is null").select("text_id", "start", "n")
        runs = now if runs is None else runs.union(now)
        same = Window.partitionBy("trigger")
        rest = (
            found.where("trigger is not null")
            .withColumn("total", F.count(F.lit(1)).over(same))
            .withColumn("any", F.max("wanted").over(same))
            .where("total > 1 and any")
            .drop("total", "any")
        )
        edges = staged(rest, "crowded")
        if edges.isEmpty():
            return runs
    return runs.union(_by_window(edges, length).select("text_id", "start", "n"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(text_id, runs): the runs (start, n) of windows that occur elsewhere, for each text
    that has some.  texts: text_id, text, doc_id; equal texts share an id."""
    same = Window.partitionBy("trigger")
    known = (
        parsed(texts, length, trigger)
        .withColumns(
            {
                "low": F.min("phrase").over(same),
                "high": F.max("phrase").over(same),
                "total": F.sum("copies").over(same),
            }
        )
        .where("total > 1")
        .withColumn("one", F.col("low") == F.col("high"))
        .drop("total", "low", "high")
    )
    known = staged(known, "repeated-triggers")
    alike = known.where("one").select("text_id", "start", "n")
    mixed_rows = known.where("not one").drop("one")
    book = staged(
        mixed_rows.groupBy("trigger", "phrase").agg(
            F.sum("copies").alias("total"), F.min(F.struct("text_id", "start")).alias("first")
        ),
        "dictionary",
    )
    rows = mixed_rows.join(book, ["trigger", "phrase"])
    equal = rows.where("total > 1").select("text_id", "start", "n")
    wanted = (F.col("total") == 1).alias("wanted")
    opened = (
        rows.where((F.col("text_id") == F.col("first.text_id")) & (F.col("start") == F.col("first.start")))
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("start", "n", "trigger", "place", wanted)).alias("runs"))
    )
    found = _repeated(_opened(texts.join(opened, "text_id"), length), length, trigger)
    return (
        alike.union(equal)
        .union(found)
        .groupBy("text_id")
        .agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    )


def _covered(size: int, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    edges = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n + (length - 1), -1)
    return np.cumsum(edges[:-1]) > 0


def _masked(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray | None]]:
    """Each text of a batch as bytes, and flags of the bytes that go (None: none)."""
    lists = batch.column("runs")
    offsets = lists.offsets.to_numpy()
    start, n = (lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
    for i, text in enumerate(batch.column("text")):
        data = text.as_py().encode("utf-8", "surrogatepass")
        rows = slice(offsets[i], offsets[i + 1])
        yield data, _covered(len(data), start[rows], n[rows], length) if len(start[rows]) else None


def _with_runs(docs: DataFrame, length: int, trigger: int) -> tuple[DataFrame, DataFrame]:
    text_batches(docs.sparkSession)
    named = docs.withColumn("text", text_or_empty()).withColumn("text_id", F.xxhash64("text"))
    runs = repeated_windows(named.select("text_id", "text", "doc_id"), length, trigger)
    return named, runs


def removed(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if it is in a string of `length` bytes that starts anywhere else too, in
    the same text or another; strings are judged on the texts as they are given.  A null
    text is empty, and loses nothing, as do texts shorter than `length`.  Rows with null or
    repeated ids are rows like any other; other columns are dropped; an empty table gives an
    empty one.  Equal strings are told by 64-bit hashes.
    """
    named, runs = _with_runs(docs.select("doc_id", "text"), length, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, mask in _masked(batch, length):
                gone = n_spans = 0
                kept = data
                if mask is not None:
                    gone = int(mask.sum())
                    n_spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
                rows.append((len(data), gone, n_spans, hashlib.sha256(kept).hexdigest()))
            figures = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], k) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *figures], FIGURES)

    joined = named.select("text_id", "text", "doc_id").join(runs, "text_id", "left")
    return joined.select(F.col("doc_id").cast("bigint"), "text", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """The documents, all columns, with the repeated bytes taken out of their texts.

    Bytes of a character that is cut in two go as well.  A null text stays null.
    """
    rows = set_aside(docs, "text").withColumns({"doc_id": F.lit(0), "_null": F.col("text").isNull()})
    named, runs = _with_runs(rows, length, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for (data, mask), null in zip(_masked(batch, length), batch.column("_null").to_pylist()):
                if mask is not None:
                    data = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
                texts.append(None if null else data.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), batch.column("_rest")], ["text", "_rest"]
            )

    joined = named.join(runs, "text_id", "left").select("text", "runs", "_null", "_rest")
    done = joined.mapInArrow(run, rows.select("text", "_rest").schema)
    return put_back(done, docs.columns)
