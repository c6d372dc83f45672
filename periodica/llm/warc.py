"""WARC archives written by Spark's text sink and read back by a salvaging reader.

A record ends in two line breaks, so the text sink with that separator writes an archive:
its commit protocol keeps whole files only, also when executors are lost.  The reader takes
one file at a time as a stream.  Where a record fails its checks it searches for the next
version line or gzip member that begins a valid record, whatever the file began with, goes
on from there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.llm.common import staged, text_or_empty
from periodica.session import work_dir

BREAK = "\r\n"
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The largest header block that is believed; more is damage.
MAX_HEADER = 1 << 20
# Inflated members up to this size stay in memory; larger ones go to a temporary file.
HELD_MEMBER = 1 << 26

RECORDS = (
    "kind string, file string, start long, end long, reason string, record_type string, "
    "target_uri string, headers map<string,string>, payload_bytes long, payload_digest string, "
    "payload binary"
)
ARROW = pa.schema(
    [("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
     ("reason", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
     ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def pages_as_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, size, kind and refers_to of one record per page.

    Of equal payloads of at least `least` bytes that with the largest page_id is the
    response, and others revisit it.  Rows that share this largest id are responses all;
    rows without an id are responses only where no equal payload has one.
    """
    payload = text_or_empty("html")
    known = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("n_bytes"),
    )
    keys = known.where(F.col("n_bytes") >= least)
    last = keys.groupBy(F.col("digest").alias("_digest"), F.col("n_bytes").alias("_bytes")).agg(
        F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    last = staged(last.where("_n > 1").drop("_n"), "last-of-payload")
    same = (F.col("digest") == F.col("_digest")) & (F.col("n_bytes") == F.col("_bytes"))
    revisits = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return (
        known.join(last, same, "left")
        .withColumn("kind", F.when(revisits, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisits, F.col("_last")))
        .drop("_digest", "_bytes", "_last")
    )


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))).otherwise("")


def record_text(date: str = DATE) -> Column:
    """One record, without the two line breaks that end it."""
    page = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + BREAK + "Content-Type: text/html; charset=utf-8" + BREAK),
        _line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit(BREAK),
    )
    block = F.when(F.col("kind") == "response", F.concat(head, "payload")).otherwise(head)
    record_id = F.sha1(F.concat_ws(" ", F.coalesce(page, F.lit("-")), "digest", F.coalesce("url", F.lit(""))))
    return F.concat(
        F.lit("WARC/1.1" + BREAK),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:sha1:"), record_id, F.lit(">"))),
        F.lit(f"WARC-Date: {date}" + BREAK),
        # A line break in an address would end the header.
        _line("WARC-Target-URI", F.url_encode("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Page-Id", page),
        _line("WARC-Profile", F.when(F.col("kind") == "revisit", PROFILE)),
        _line("Refers-To-Page-Id", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + BREAK),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
        block,
    )


def write_archive(records: DataFrame, path: str) -> None:
    """Writes the records as WARC files, one per task."""
    records.select(record_text().alias("value")).write.option("lineSep", BREAK * 2).text(path)


class _Plain:
    """A window over an open file; positions are bytes of the file."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at, self.held = stream, size, 0, b""

    def bytes(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start < self.at or end > self.at + len(self.held):
            self.stream.seek(start)
            self.held = self.stream.read(max(end - start, 1 << 20))
            self.at = start
        return self.held[start - self.at : end - self.at]

    def find(self, mark: re.Pattern, start: int) -> int:
        while start < self.size:
            part = self.bytes(start, start + (1 << 20))
            if found := mark.search(part):
                return start + found.start()
            if len(part) < 1 << 20:
                break
            start += len(part) - LONGEST_MARK + 1
        return -1


class Damaged(Exception):
    """A record that fails its checks; end: where the next begins, if that can be trusted."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


MEMBER = b"\x1f\x8b\x08"
LONGEST_MARK = len(b"WARC/1.")
_RECORD_MARK = re.compile(rb"WARC/1\.")
_ANY_MARK = re.compile(rb"WARC/1\.|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _parsed(view: _Plain, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at start."""
    if not _VERSION.match(view.bytes(start, start + 10)):
        raise Damaged("no version line")
    stop = start
    while True:
        part = view.bytes(start, stop + 4096)
        k = part.find(b"\r\n\r\n")
        if k >= 0:
            break
        stop += 4096
        if stop >= view.size or stop - start > MAX_HEADER:
            raise Damaged("header without end")
    headers: dict[str, str] = {}
    for line in part[:k].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 15:
        raise Damaged("no content length")
    begin = start + k + 4
    end = begin + int(length)
    if end + 4 > view.size:
        raise Damaged("record goes beyond the file")
    if view.bytes(end, end + 4) != b"\r\n\r\n":
        raise Damaged("record does not end where it says")
    return headers, view.bytes(begin, end), end + 4


def _told(digest: str) -> tuple[str, bytes] | None:
    """Algorithm and value of a digest line; None where one is not known.

    Values are in hex, base32 or base64, as their length tells.
    """
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    size, value = hashlib.new(name).digest_size, value.strip()
    bare = value.rstrip("=")
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        if len(bare) == -(-size * 8 // 5):
            return name, base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))
        if len(bare) == -(-size * 8 // 6):
            return name, base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except (ValueError, binascii.Error):
        pass
    return None


def _checked(headers: dict[str, str], block: bytes) -> tuple[dict, bytes, bool]:
    """Payload figures, payload, and whether a digest confirms it; raises Damaged where they
    do not fit.  The payload of other records than responses is their whole block."""
    kind = headers.get("warc-type")
    line = headers.get("warc-payload-digest")
    told = _told(line or "")
    payload, whole = block, kind in ("resource", "conversion", "warcinfo", "metadata")
    if kind == "response":
        whole = True
        if block.startswith(b"HTTP/") or headers.get("content-type", "").lower().startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
    if whole and told and hashlib.new(told[0], payload).digest() != told[1]:
        raise Damaged("payload differs from its digest")
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = headers.get("warc-payload-length", "")
        size = int(size) if size.isascii() and size.isdigit() else len(payload) if whole else None
        digest = told[1].hex() if told and told[0] == "sha1" else (line or "").removeprefix("sha1:") or None
    return {"record_type": kind, "payload_bytes": size, "payload_digest": digest}, payload, bool(whole and told)


def _gap(start: int, end: int, reason: str) -> dict:
    return {"kind": "gap", "start": start, "end": end, "reason": reason}


def _record(start: int, end: int, headers: dict[str, str], block: bytes) -> dict:
    figures, payload, sure = _checked(headers, block)
    uri = headers.get("warc-target-uri")
    return figures | {
        "kind": "record",
        "start": start,
        "end": end,
        "headers": headers,
        "target_uri": uri and unquote(uri.replace("+", " ")),
        "payload": payload,
        "sure": sure,
    }


def _inflated(view: _Plain, at: int, out) -> tuple[int, str]:
    """Writes what inflates of the member at a place; its end, and why it is not whole."""
    inflate, end = zlib.decompressobj(31), at
    while not inflate.eof:
        part = view.bytes(end, end + (1 << 16))
        if not part:
            return end, "member goes beyond the file"
        before = inflate.copy()
        try:
            out.write(inflate.decompress(part))
        except zlib.error:
            # The call gives nothing of this part; byte by byte it is what comes before the damage.
            try:
                for k in range(len(part)):
                    out.write(before.decompress(part[k : k + 1]))
            except zlib.error:
                pass
            return end, "member does not inflate"
        end += len(part) - len(inflate.unused_data)
    return end, ""


def _member(view: _Plain, at: int) -> Iterator[dict]:
    """Records and gaps of the member at a place, with the places of the member."""
    with SpooledTemporaryFile(HELD_MEMBER) as out:
        end, broken = _inflated(view, at, out)
        size, found = out.tell(), False
        for row in read_records(_Plain(out, size), members=False):
            if row["kind"] == "gap" and (row["start"], row["end"]) == (0, size) and not broken:
                raise Damaged(row["reason"], end)
            # Without the checksum of the whole member, only what has one of its own is believed.
            if not broken or row.get("sure"):
                found = True
                yield row | {"start": at, "end": end}
        if broken:
            raise Damaged(broken)
        if not found:
            raise Damaged("member holds no record", end)


def _one(view: _Plain, at: int) -> Iterator[dict]:
    headers, block, end = _parsed(view, at)
    try:
        yield _record(at, end, headers, block)
    except Damaged as e:  # its frame is whole: what is inside is not searched
        raise Damaged(e.reason, end) from None


def read_records(view: _Plain, members: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive, in order; with members, also of gzip members.

    A member may hold any number of records; they, and gaps between them, have its places.
    Of a member that does not inflate to its end, records that their own digests confirm are
    found, and its bytes are a gap besides.
    """
    mark = _ANY_MARK if members else _RECORD_MARK
    at, gap, reason = 0, None, ""
    while at < view.size:
        here = _member if members and view.bytes(at, at + 3) == MEMBER else _one
        try:
            for row in here(view, at):
                if gap is not None:
                    yield _gap(gap, at, reason)
                    gap = None
                yield row
                end = row["end"]
        except Damaged as e:
            if gap is None:
                gap, reason = at, e.reason
            at = e.end or view.find(mark, at + 1)
            if at < 0:
                break
            if e.end:
                yield _gap(gap, at, reason)
                gap = None
            continue
        at = end
    if gap is not None:
        yield _gap(gap, view.size, reason)


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record (kind `record`) and every unreadable stretch (kind `gap`) of the files.

    file, start and end say where; gaps have a reason; records have their type, address,
    headers, payload figures and, with payloads, the payload, which is the whole block of all
    but responses.  Records and gzip members may follow each other in any order.  Digests are
    compared by algorithm and encoding; those of unknown ones are not checked.  Spark lists
    the files and deals them to tasks by size; a task holds one record at a time besides a
    window of the file, and of a large member a temporary file.  An empty folder or file has
    no rows.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as stream:
                    view = _Plain(stream, size)
                    held, rows = 0, []
                    for row in read_records(view):
                        held += len(row.get("payload") or b"") + 1000
                        row.pop("sure", None)
                        if not payloads:
                            row.pop("payload", None)
                        rows.append(row | {"file": name})
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            held, rows = 0, []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)

    return listed.mapInArrow(read, RECORDS)


def page_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages written to archives and read back: a row per page, from the archives alone.

    Null html is an empty payload; null addresses and ids have no header line.  Extra
    columns are dropped.
    """
    spark = pages.sparkSession
    path = path or work_dir(spark, "warc")
    write_archive(pages_as_records(pages), path)
    found = read_archive(spark, path, payloads=False).where("kind = 'record'")
    return found.select(
        F.col("headers")["page-id"].cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("headers")["refers-to-page-id"].cast("bigint").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
