"""Stretches of words that repeat with a period, by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; level k of the dictionary numbers the factors of a
text so that equal ones have one number, which comes from the numbers of their halves.  Where
a factor occurs again within twice its length, the distance is proposed as a period; places
side by side with the same distance are one arithmetic progression of occurrences, and
propose a stretch.  Stretches that are long enough are extended as far as the words agree,
and those that several levels propose are taken once.

Nothing is missed: a run of period q and at least 3 q words has factors of the length
2^k >= q > 2^(k-1), of which each occurs again after exactly q words as long as it fits in,
so that level k proposes the whole run.  A distance is always that of the next occurrence;
a stretch of three or more such distances has no smaller period, for else the factor would
have occurred earlier.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from periodica.llm.common import put_back, set_aside, text_batches, text_or_empty, texts_of, words_of

# A run has at least so many words, and so many times its period.
LEAST, TIMES = 24, 3
# Texts are taken together up to so many bytes; the words of a longer one are read one by one.
CHUNK = 1 << 21
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

RUNS = "doc_id long, start long, length long, period long"
DIGESTS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
     ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
     ("collapsed_sha256", pa.string())]
)


def _words(raw: bytes) -> Iterable[bytes]:
    """The words of a text; those of a long one are not all held at once."""
    return raw.split() if len(raw) <= CHUNK else (found[0] for found in WORD.finditer(raw))


def _grouped(texts: list[str]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def _numbers(raws: list[bytes]) -> list[np.ndarray]:
    """The words of each text as numbers, equal words with one number."""
    book: dict[bytes, int] = defaultdict(count().__next__)
    return [np.fromiter(map(book.__getitem__, _words(raw)), dtype=np.int64) for raw in raws]


def _alike(words: np.ndarray, x: int, y: int, most: int) -> int:
    """How many equal words begin at x and at y, of the next `most`."""
    done, block = 0, 64
    while done < most:
        block = min(2 * block, most - done)
        differ = words[x + done : x + done + block] != words[y + done : y + done + block]
        if differ.any():
            return done + int(differ.argmax())
        done += block
    return done


def _extended(words: np.ndarray, start: int, stop: int, period: int, first: int, last: int) -> tuple[int, int]:
    """The widest stretch around words[start:stop], inside [first, last), that keeps the period."""
    stop += _alike(words, stop - period, stop, last - stop)
    back, n = words[::-1], len(words)
    start -= _alike(back, n - start, n - start - period, start - first)
    return start, stop


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs again, and their keys as small numbers."""
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    more = times[name] > 1
    return at[more], name[more]


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start, then period."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not all found")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.concatenate([*texts, np.zeros(0, dtype=np.int64)])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    at = np.arange(len(words))
    dense = np.full(len(words), -1, dtype=np.int64)
    # Numbers are of one text each, so that nothing is next to an equal factor of another text.
    at, name = _repeated(at, words * max(len(texts), 1) + owner)
    size = 1
    while len(at):
        order = np.argsort(name, kind="stable")
        after = np.zeros(len(at), dtype=np.int64)
        again = name[order[1:]] == name[order[:-1]]
        after[order[:-1]] = np.where(again, at[order[1:]] - at[order[:-1]], 0)
        near = np.flatnonzero((after > 0) & (after <= 2 * size))
        if len(near):
            place, period = at[near], after[near]
            opens = np.append(True, (np.diff(place) != 1) | (np.diff(period) != 0))
            first = np.flatnonzero(opens)
            start, period = place[first], period[first]
            stop = place[np.append(first[1:], len(near)) - 1] + size + period
            for k in np.flatnonzero(stop - start >= np.maximum(least, times * period)).tolist():
                d, q = int(owner[start[k]]), int(period[k])
                low = int(ends[d] - sizes[d])
                a, b = _extended(words, int(start[k]), int(stop[k]), q, low, int(ends[d]))
                found[d].add((a - low, b - a, q))
        # The next level: factors of two halves that occur again, inside one text.
        dense[at] = name
        inside = at + 2 * size <= ends[owner[at]]
        both = at[inside]
        other = dense[both + size]
        key = name[inside] * (int(name.max()) + 1) + other
        dense[at] = -1
        at, name = _repeated(both[other >= 0], key[other >= 0])
        size *= 2
    return [sorted(f, key=lambda run: (run[0], run[2])) for f in found]


def _dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of the words that are in a run after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _kept(raw: bytes, runs: list[tuple[int, int, int]], n: int) -> Iterable[bytes]:
    return compress(_words(raw), (~_dropped(n, runs)).tolist()) if runs else _words(raw)


def _judged(texts: list[str], least: int, times: int) -> Iterator[tuple[bytes, int, list[tuple[int, int, int]]]]:
    """Each text as bytes, how many words it has, and its runs."""
    for raws in _grouped(texts):
        numbers = _numbers(raws)
        yield from zip(raws, map(len, numbers), runs_of(numbers, least, times))


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period), one row for each run of each whole text.

    Words are stretches without white space, numbered from 0.  A run is a stretch whose
    words recur after `period` words, that no neighbouring word extends, of at least `least`
    words and `times` periods, and of no smaller period.  Null and empty texts have none;
    repeated rows have theirs again, null ids stay null, other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, (_, _, runs) in zip(ids, _judged(texts_of(batch), least, times)):
                rows += [(doc, *r) for r in runs]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "period"]
            )

    text_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, RUNS)


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The documents, all columns, with each run cut down to its first period.

    The words of such a text are then joined by one space; a text without runs stays as it
    is, and a null one null.
    """
    rows = set_aside(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("text").to_pylist()
            texts = [
                b" ".join(_kept(raw, runs, n)).decode("utf-8", "surrogatepass") if runs else text
                for text, (raw, n, runs) in zip(given, _judged([t or "" for t in given], least, times))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), batch.column("_rest")], ["text", "_rest"]
            )

    text_batches(docs.sparkSession)
    return put_back(rows.mapInArrow(run, rows.schema), docs.columns)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row a document: its runs and its collapsed text in figures, as op11 gives them.

    start, length, period and exponent_milli are of the run with the most periods (ties: the
    smallest start, then period), and null without one.  A null text is empty: no runs, and
    the digests of nothing.
    """

    def digest(words: Iterable[bytes]) -> str:
        out, before = hashlib.sha256(), b""
        if isinstance(words, list):
            return hashlib.sha256(b" ".join(words)).hexdigest()
        for word in words:
            out.update(before + word)
            before = b" "
        return out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, (raw, n, runs) in zip(
                batch.column("doc_id").to_pylist(), _judged(texts_of(batch), least, times)
            ):
                best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                rows.append(
                    (
                        doc,
                        len(runs),
                        *(best or (None,) * 3),
                        1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(lines.encode()).hexdigest(),
                        digest(_kept(raw, runs, n)),
                    )
                )
            columns = zip(*rows) if rows else [[]] * len(_DIGESTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _DIGESTS)], schema=_DIGESTS
            )

    text_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, DIGESTS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), with a periodic tail in a tenth of the documents.

    Which ones, and where the tail begins and what its period is, follows from the crc32 of
    the decimal id.  The tail is whole periods of the text's own words, cut at its length.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = words_of(text_or_empty())
    n = F.size(words)
    a = F.expr("cast(_g % _n as int)")
    p = F.expr("1 + cast((_n - _a) div (3 + _g % 8) as int)")
    times = F.expr("cast(ceil((_n - _a) / _p) as int)")
    whole = F.concat(
        F.slice("_words", F.lit(1), F.col("_a")),
        F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.col("_times"))),
    )
    planted = F.array_join(F.slice(whole, F.lit(1), F.col("_n")), " ")
    rows = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"))
    chosen = F.col("_h") % 10 == 0
    rows = rows.withColumn("_words", F.when(chosen, words))
    rows = rows.withColumn("_n", F.when(chosen, F.size("_words")).otherwise(0))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, a))
    rows = rows.withColumn("_p", p)
    rows = rows.withColumn("_times", times)
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))
