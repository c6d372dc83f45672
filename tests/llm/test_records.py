import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException
from tokenizers import Tokenizer

import __spark_entry__ as entry
from periodica.llm import checksums, records
from periodica.llm.queries import WORD_VOCABULARY
from periodica.session import work_dir

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_plain_texts_are_split_whole_and_their_letters_encoded_together():
    rng = random.Random(2)
    letters = "abAB'stSTdD.,!-<|>_09ÀßéÞ" + " \n\t\r\x0b\x0c"
    others = letters + "\x1c\x85\xa0×÷Σς日🙂\u0301"
    texts = ["", " ", "a,", "don't'S 'll x'VE.", "<|endoftext|> A<|startoftext|>!", "ß ẞ SS ß,", "--a-- -- b--"]
    texts += ["".join(rng.choice(s) for _ in range(rng.randrange(120))) for s in (letters, others) for _ in range(500)]
    coder = records.WordCoder(WORD_VOCABULARY)
    whole = Tokenizer.from_file(WORD_VOCABULARY)
    whole.encode_special_tokens = True
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for at in range(0, len(texts), 100) for ids in coder.encode(texts[at : at + 100])] == expected
    coder = records.WordCoder(WORD_VOCABULARY)
    coder.encode(["Plain words, and some more of them: plain."])
    assert len(coder.words) == 0 and len(coder.parts) == 10


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rng = random.Random(3)
    messages = [b"123456789", bytes(32), *(rng.randbytes(n) for n in (4, 8, 255, 256, 257, 511, 512, 513, 3000))]
    data = np.frombuffer(b"".join(messages), np.uint8)
    got = checksums.masked_checksums(data, np.array([len(m) for m in messages]))

    def masked(crc):
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    assert got.tolist() == [masked(plain_crc32c(m)) for m in messages]
    assert checksums.masked_checksums(data[:0], np.zeros(0, int)).tolist() == []


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(WORD_VOCABULARY)
    found.encode_special_tokens = True
    return found


ODD = ["dogs' 'tis it's. l'été, ÉTÉ; à.'s ÷5× 3.5, x.́ µ, ß! don't's ''s","<|endoftext|> it's WE'LL 's", "e ́x́    a b", "ΑΣ Σ ΟΔΟΣ", "\x1c a\x85b　c", "İ ﬁ Å",
       "ᄀ ᅡ가", "a" * 3000, "١٢ 12 1 2", "ẋ̣ ẋ̣"]


def test_ids_are_those_of_the_library(hard_texts, tokenizer):
    rng = random.Random(8)
    signs = "aAßΣsrevmldé'’ \n\t   12٣!?-_日本🙂́\r''   \x1c\x85İ  "
    texts = [t or "" for t in hard_texts] + ODD
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(3000)]
    coder = records.WordCoder(WORD_VOCABULARY)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want
    assert [x.tolist() for x in coder.encode(texts[::-1])] == want[::-1]
    coder.held = records.KNOWN_BYTES + 1
    assert [x.tolist() for x in coder.encode(texts)] == want


def expected(rows, tokenizer):
    """rows in order -> the rows of op12."""
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def test_files_are_read_back_in_order(spark, docs_of, hard_texts, tokenizer, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 3000)
    rows = [(i * 37 % 1009, t) for i, t in enumerate(hard_texts + ODD)]
    folder = work_dir(spark, "records")
    records.write_tokens(docs_of(rows), folder, WORD_VOCABULARY)
    got = sorted(tuple(r) for r in records.record_digests(spark, folder).collect())
    assert got == expected(sorted(rows, key=lambda r: r[0]), tokenizer)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    one = [tuple(r) for r in records.read_sequences(spark, folder, order=1).collect()]
    two = [tuple(r) for r in records.read_sequences(spark, folder, order=2).collect()]
    assert dict(one) == dict(two) == ids and one != two
    assert one == [tuple(r) for r in records.read_sequences(spark, folder, order=1).collect()]
    some = records.read_index(spark, folder).where("doc_id % 3 = 0")
    assert dict(map(tuple, records.sequences_at(some, folder).collect())) == {d: x for d, x in ids.items() if d % 3 == 0}


def test_null_and_repeated_ids_and_no_rows(spark, docs_of, tokenizer):
    rows = [(None, "a b"), (5, "c"), (None, None), (5, "c"), (5, ""), (-3, "d e f"), (2**62, "g")]
    folder = work_dir(spark, "records")
    records.write_tokens(docs_of(rows), folder, WORD_VOCABULARY)
    got = sorted((tuple(r) for r in records.record_digests(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -3, 5, 5, 5, 2**62]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)]).tolist()[:-1]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows, tokenizer))
    empty = work_dir(spark, "records")
    records.write_tokens(docs_of(rows).limit(0), empty, WORD_VOCABULARY)
    assert records.record_digests(spark, empty).count() == 0
    assert records.read_sequences(spark, empty, order=3).count() == 0


def test_wide_ids_and_frames(spark):
    ids = [[1, 70_000, 2**32 - 1], [], None, list(range(9))]
    folder = work_dir(spark, "records")
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<long>")
    records.write_sequences(rows, folder)
    assert sorted(tuple(r) for r in records.read_sequences(spark, folder).collect()) == [
        (k, x or []) for k, x in enumerate(ids)
    ]
    # The frames as their description says.
    names = sorted(os.listdir(f"{folder}/data"))
    data = b"".join(open(f"{folder}/data/{n}", "rb").read() for n in names)
    at, seen = 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        doc, null, width = struct.unpack_from("<qBB", data, at + 12)
        seen.append((doc, null, width, n))
        at += 12 + n + 4
    assert seen == [(0, 0, 4, 24), (1, 0, 4, 12), (2, 0, 4, 12), (3, 0, 4, 48)]


@pytest.mark.parametrize("place, what", [(0, "length"), (9, "length"), (30, "payload"), (-1, "payload")])
def test_damage_is_found(spark, place, what):
    folder = work_dir(spark, "records")
    rows = spark.createDataFrame([(1, list(range(30)))], "doc_id long, ids array<long>")
    records.write_sequences(rows, folder)
    (name,) = [n for n in os.listdir(f"{folder}/data") if n.endswith(".records")]
    data = bytearray(open(f"{folder}/data/{name}", "rb").read())
    data[place] ^= 1
    open(f"{folder}/data/{name}", "wb").write(data)
    with pytest.raises(PythonException, match=f"the {what} of the record at byte 0"):
        records.record_digests(spark, folder).collect()


def test_files_of_lost_attempts_are_not_read(spark):
    folder = work_dir(spark, "records")
    rows = spark.createDataFrame([(1, [5])], "doc_id long, ids array<long>")
    records.write_sequences(rows, folder)
    open(f"{folder}/data/part-000000-lost.records", "wb").write(b"half a frame")
    assert [tuple(r) for r in records.read_sequences(spark, folder).collect()] == [(1, [5])]
    assert records.record_digests(spark, folder).count() == 1


def test_query_equals_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in entry.queries()["op12_binary_records"](spark, FOLDER).collect())
    assert got == expected(sorted((tuple(r) for r in docs), key=lambda r: r[0]), tokenizer)
