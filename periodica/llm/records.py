"""Token ids in length-delimited binary record files, with an index for shuffled reads.

A file is a sequence of frames: the length of the payload (8 bytes, little-endian), the
masked CRC-32C of these 8 bytes, the payload, and the masked CRC-32C of the payload.  So a
reader knows where each record ends before it trusts a byte of it, and tells a damaged
length from damaged ids.  A payload is a document's id (8 bytes), a flag for a null id, the
bytes of a token id (2 or 4), two zero bytes, and the ids.

The documents are sorted by range, and each task writes one file of its own name and yields
the index of it: where each record is, and how many ids the file holds before it.  Spark
commits the index, and with it the files: those of lost or repeated attempts are in no index
and are never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.llm.checksums import masked_checksums
from periodica.llm.common import text_batches, texts_of

END_ID = 2
HEAD, FRAME_HEAD, FRAME_TAIL = 12, 12, 4
CHUNK = 1 << 21
BLOCK = 1 << 22
# A worker forgets its words when it has met so many, or so many bytes of them.
KNOWN, KNOWN_BYTES = 600_000, 1 << 25
# Plain Latin letters, numbers and signs: up to the last letter or number, and the signs after it.
PLAIN = re.compile(r"([!-~À-ÖØ-öø-ÿ]*[A-Za-z0-9À-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]*)")
# Texts of such letters and white space alone; in small ones, signs between a letter or number and white space.
PLAIN_TEXT = re.compile(r"[\x20\x09-\x0D!-~À-ÖØ-öø-ÿ]*")
LAST_SIGNS = re.compile(r"[!-/:-@\[-`{-~](?<=[a-z0-9ß-öø-ÿ].)[!-/:-@\[-`{-~]*(?!\S)")
# One piece for the tokenizer, which ends with the only token that closes it.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
JOINED = 1000

INDEX = "part int, file string, doc_id long, offset long, n_bytes long, n_tokens long, before long"
_INDEX = pa.schema(
    [("part", pa.int32()), ("file", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()),
     ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())]
)
Encode = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


class WordCoder:
    """Encodes texts with a tokenizer that drops white space, a distinct word at a time.

    Its splits never cross white space and its normal forms never reach over it, so a
    text's ids are those of its words, one after the other.  A word of plain Latin letters
    falls in two where signs follow its last letter or number, as no split reaches over
    that place either, and its letters are made small, as the tokenizer does itself.  A text
    of such letters alone is made small and split at these places as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.parts: dict[str, int] = defaultdict(count().__next__)
        self.parts_of = np.zeros((0, 2), dtype=np.int64)  # of each word: its two parts
        self.starts = self.sizes = np.zeros(0, dtype=np.int64)  # of each part: its ids
        self.ids = np.zeros(0, dtype=np.uint32)
        self.held = 0

    def _split(self, words: list[bytes]) -> None:
        """Takes in the parts of words that have got their numbers only."""
        pairs = []
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            plain = PLAIN.fullmatch(text)
            pairs += (plain[1].lower(), plain[2]) if plain else (text, "")
        found = np.fromiter(map(self.parts.__getitem__, pairs), dtype=np.int64, count=len(pairs))
        self.parts_of = np.concatenate([self.parts_of, found.reshape(-1, 2)])
        self.held += sum(map(len, words))

    def _learn(self) -> None:
        """Takes in the ids of parts that have got their numbers only."""
        new = [*islice(self.parts, len(self.sizes), None)]
        flat, sizes = self._encoded(new)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.held += sum(map(len, new))

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after the other, and how many each has."""
        ids: list[list[int]] = []
        for at in range(0, len(parts), 10_000):
            encoded = self.tokenizer.encode_batch_fast(parts[at : at + 10_000], add_special_tokens=False)
            ids += [e.ids for e in encoded]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _each; those of letters alone go joined by spaces, and are told apart by the
        tokens that close them."""
        one = np.fromiter((LETTERS.fullmatch(p) is not None for p in parts), dtype=bool, count=len(parts))
        plain = [p for p, x in zip(parts, one.tolist()) if x]
        joined = [" ".join(plain[at : at + JOINED]) for at in range(0, len(plain), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = [np.array(e.ids, dtype=np.uint32) for e in encoded]
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(plain):  # a vocabulary whose tokens do not tell where pieces end
            return self._each(parts)
        others, of_others = self._each([p for p, x in zip(parts, one.tolist()) if not x])
        sizes = np.zeros(len(parts), dtype=np.int64)
        sizes[one], sizes[~one] = np.diff(ends, prepend=0), of_others
        flat = np.zeros(int(sizes.sum()), dtype=np.uint32)
        mine = np.repeat(one, sizes)
        flat[mine], flat[~mine] = ids, others
        return flat, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > KNOWN or len(self.parts) > KNOWN or self.held > KNOWN_BYTES:
            self.clear()
        plain = np.fromiter((PLAIN_TEXT.fullmatch(t) is not None for t in texts), dtype=bool, count=len(texts))
        split = [
            LAST_SIGNS.sub(r" \g<0>", t.lower()).split() if p else t.encode("utf-8", "surrogatepass").split()
            for t, p in zip(texts, plain.tolist())
        ]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        n_parts = np.where(plain, n, 2 * n)  # of each text
        parts = np.empty(int(n_parts.sum()), dtype=np.int64)
        mine = np.repeat(plain, n_parts)
        if not plain.all():
            words = chain.from_iterable(s for s, p in zip(split, plain.tolist()) if not p)
            which = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=int(n[~plain].sum()))
            if len(self.words) > len(self.parts_of):
                self._split([*islice(self.words, len(self.parts_of), None)])
            parts[~mine] = self.parts_of[which].ravel()
        own = chain.from_iterable(s for s, p in zip(split, plain.tolist()) if p)
        parts[mine] = np.fromiter(map(self.parts.__getitem__, own), dtype=np.int64, count=int(n[plain].sum()))
        if len(self.parts) > len(self.sizes):
            self._learn()
        sizes = self.sizes[parts]
        total = np.append(0, np.cumsum(sizes))
        out = self.ids[np.repeat(self.starts[parts] - total[:-1], sizes) + np.arange(int(total[-1]))]
        ends = total[np.cumsum(n_parts)]
        return np.split(out, ends[:-1])


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of texts, or of parts of long ones cut at white space, and whose they are."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > CHUNK:
                cut = max(text.rfind(c, at, at + CHUNK) for c in " \n")
                end = cut if cut > at else end
            held.append(text[at:end])
            owners.append(i)
            size += end - at
            at = end
            if size > CHUNK:
                yield held, owners
                held, owners, size = [], [], 0
            if at >= len(text):
                break
    if held:
        yield held, owners


def word_encoder(path: str, end_id: int = END_ID) -> tuple[Encode, int]:
    """An encoder of the texts of a batch, each with an end id, and the bytes of an id."""

    def encode(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        words, end = coder(path), np.array([end_id], dtype=np.uint32)
        own, last = [], 0
        for parts, owners in _parts(texts_of(batch)):
            for ids, i in zip(words.encode(parts), owners):
                if i != last:
                    yield np.concatenate([*own, end])
                    own, last = [], i
                own.append(ids)
        if batch.num_rows:
            yield np.concatenate([*own, end])

    return encode, coder(path).width


def _framed(docs: list[int | None], ids: list[np.ndarray], width: int) -> tuple[bytes, np.ndarray]:
    """The frames of records, and the sizes of their payloads."""
    payloads = [
        struct.pack("<qBBxx", d or 0, d is None, width) + x.astype(f"<u{width}").tobytes()
        for d, x in zip(docs, ids)
    ]
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    lengths = sizes.astype("<u8").tobytes()
    of_lengths = masked_checksums(np.frombuffer(lengths, np.uint8), np.full(len(sizes), 8)).astype("<u4").tobytes()
    of_data = masked_checksums(np.frombuffer(b"".join(payloads), np.uint8), sizes).astype("<u4").tobytes()
    frames = []
    for k, payload in enumerate(payloads):
        frames += [lengths[8 * k : 8 * k + 8], of_lengths[4 * k : 4 * k + 4], payload, of_data[4 * k : 4 * k + 4]]
    return b"".join(frames), sizes


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, encode: Encode, width: int) -> None:
    """Record files of all rows in ascending order of doc_id, and their index.

    docs: doc_id and what `encode` reads; it yields the ids of each row of a batch.  Null
    ids come first; rows of one id stay in their order in the table, and may be in several
    files, so that no id makes a file larger than others.  `folder` is a path or URI that
    all executors share; it gets `data` and `index`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file = f"data/part-{part:06d}-{uuid.uuid4().hex}.records"
        store, path = _place(f"{folder}/{file}")
        stream, offset, before = None, 0, 0
        try:
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                waiting: list[np.ndarray] = []
                done = 0

                def flush() -> pa.RecordBatch:
                    nonlocal offset, before, done, stream
                    if stream is None:
                        store.create_dir(os.path.dirname(path), recursive=True)
                        stream = store.open_output_stream(path)
                    own = keys[done : done + len(waiting)]
                    frames, sizes = _framed(own, waiting, width)
                    stream.write(frames)
                    ends = np.cumsum(sizes + FRAME_HEAD + FRAME_TAIL)
                    counts = np.array([len(x) for x in waiting], dtype=np.int64)
                    rows = [
                        np.full(len(own), part), [file] * len(own), own, offset + ends - sizes - FRAME_TAIL,
                        sizes, counts, before + np.cumsum(counts) - counts,
                    ]
                    offset += int(ends[-1])
                    before += int(counts.sum())
                    done += len(own)
                    waiting.clear()
                    return pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(rows, _INDEX)], schema=_INDEX
                    )

                held = 0
                for ids in encode(batch):
                    waiting.append(ids)
                    held += len(ids)
                    if held > BLOCK // 4:
                        yield flush()
                        held = 0
                if waiting:
                    yield flush()
        finally:
            if stream is not None:
                stream.close()

    ordered = (
        docs.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_row")
        .sortWithinPartitions("doc_id", "_row")
        .drop("_row")
    )
    ordered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """The record files of documents, tokenized by the words of a vocabulary file.

    A null or empty text has the end id alone.  Other columns are dropped.
    """
    text_batches(docs.sparkSession)
    encode, width = word_encoder(path, end_id)
    write_records(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), folder, encode, width)


def write_sequences(rows: DataFrame, folder: str, width: int = 4) -> None:
    """The record files of (doc_id, ids array) rows; a null array is empty."""

    def encode(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for ids in batch.column("ids"):
            yield np.array(ids.as_py() or [], dtype=np.uint32)

    text_batches(rows.sparkSession)
    write_records(
        rows.selectExpr("cast(doc_id as bigint) as doc_id", "cast(ids as array<bigint>) as ids"), folder, encode, width
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, first): a row for each file, each in a partition of its own.

    There are as many as the write had tasks, so the driver holds a row for each, as it has
    held the tasks themselves.
    """
    end = F.max(F.col("offset") + F.col("n_bytes") + FRAME_TAIL)
    each = read_index(spark, folder).groupBy("part", "file").agg(F.sum("n_tokens").alias("n"), end.alias("size"))
    rows, first = [], 0
    for row in sorted(each.collect()):
        rows.append((row["file"], row["size"], first))
        first += row["n"]
    files = spark.createDataFrame(rows, "file string, size long, first long")
    return files.coalesce(1).repartition(max(len(rows), 1))


def _bad(file: str, offset: int, what: str) -> ValueError:
    return ValueError(f"{file}: {what} of the record at byte {offset} is damaged")


def _checked(file: str, data: bytes, spans: list[tuple[int, int]], at: int, whole: bool) -> list[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of payloads at the spans (offset in data, size); checksums must agree.

    at: where data is in the file; whole: whether the lengths before them are checked too.
    """
    raw = np.frombuffer(data, np.uint8)

    def stored(places: np.ndarray) -> np.ndarray:
        return raw[places[:, None] + np.arange(4)].view("<u4").ravel()

    start, size = (np.array(c, dtype=np.int64) for c in zip(*spans))
    if whole:
        lengths = raw[(start - FRAME_HEAD)[:, None] + np.arange(8)].ravel()
        wrong = masked_checksums(lengths, np.full(len(start), 8)) != stored(start - 4)
        if wrong.any():
            raise _bad(file, at + int(start[wrong.argmax()]) - FRAME_HEAD, "the length")
    payloads = np.concatenate([raw[a : a + n] for a, n in spans])
    wrong = masked_checksums(payloads, size) != stored(start + size)
    if wrong.any():
        raise _bad(file, at + int(start[wrong.argmax()]) - FRAME_HEAD, "the payload")
    out = []
    for a, n in spans:
        doc, null, width = struct.unpack_from("<qBB", data, a)
        out.append((None if null else doc, np.frombuffer(data, f"<u{width}", (n - HEAD) // width, a + HEAD)))
    return out


def _records(uri: str, size: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The records of a file's first `size` bytes in order, some MB at a time."""
    store, path = _place(uri)
    with store.open_input_stream(path) as stream:
        held, at = b"", 0
        while at + len(held) < size or held:
            more = stream.read(min(BLOCK, size - at - len(held)))
            if not more and at + len(held) < size:
                raise _bad(uri, at, "the end")
            held += more
            spans, place = [], 0
            while place + FRAME_HEAD <= len(held):
                (n,) = struct.unpack_from("<Q", held, place)
                if place + FRAME_HEAD + n + FRAME_TAIL > len(held):
                    wanted = at + place + FRAME_HEAD + n + FRAME_TAIL
                    if wanted > size:
                        raise _bad(uri, at + place, "the length")
                    break
                if n < HEAD:
                    raise _bad(uri, at + place, "the length")
                spans.append((place + FRAME_HEAD, n))
                place += FRAME_HEAD + n + FRAME_TAIL
            if not spans and not more:
                raise _bad(uri, at, "the end")
            if spans:
                yield _checked(uri, held, spans, at, True)
            held, at = held[place:], at + place


def record_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all records, read from the files in order.

    start: the ids of all records before it, in all files; ids_crc32: of the ids as
    little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                for records in _records(f"{folder}/{file}", size):
                    counts = np.array([len(ids) for _, ids in records], dtype=np.int64)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in records]
                    starts = first + np.cumsum(counts) - counts
                    first += int(counts.sum())
                    columns = ([doc for doc, _ in records], starts, counts, crcs)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequences(spark: SparkSession, folder: str, order: str | int | None = None) -> DataFrame:
    """(doc_id, ids) of all records, read by the index at their own places.

    order: a number shuffles them, another one otherwise; None leaves the order of the index.
    """
    rows = read_index(spark, folder).select("file", "offset", "n_bytes")
    if order is not None:
        chance = F.xxhash64(F.lit(str(order)), "file", "offset")
        rows = rows.withColumn("_chance", chance).repartitionByRange("_chance")
        rows = rows.sortWithinPartitions("_chance").drop("_chance")
    return sequences_at(rows, folder)


def sequences_at(places: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the records at some rows of the index, in the order of these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            docs, found = [], []
            for file, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_bytes"))):
                if file != name:
                    if source is not None:
                        source.close()
                    store, path = _place(f"{folder}/{file}")
                    name, source = file, store.open_input_file(path)
                data = source.read_at(n + FRAME_TAIL, offset)
                ((doc, ids),) = _checked(file, data, [(0, n)], offset, False)
                docs.append(doc)
                found.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"]
            )
        if source is not None:
            source.close()

    return places.select("file", "offset", "n_bytes").mapInArrow(run, "doc_id long, ids array<long>")
