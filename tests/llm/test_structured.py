"""Words made so that a polynomial hash modulo a power of two cannot tell them apart."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from periodica.llm import bpe, ngrams, packing, periods, pretokens, records, substrings
from periodica.llm.queries import RANKS, VOCABULARY, WORD_VOCABULARY
from periodica.session import work_dir
from tests.llm import brute


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


SIZES = (512, 1024, 2048, 4096)
WORDS = [w for n in SIZES for w in (thue_morse(n), thue_morse(n, "b", "a"))]


def test_op5_ids_and_texts(docs_of):
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    texts = [*WORDS, " ".join(WORDS), " ".join(WORDS[::-1])]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs_of(list(enumerate(texts))), RANKS).collect()}
    for i, text in enumerate(texts):
        ids = encoding.encode_ordinary(text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op7_and_op12_ids(spark, docs_of):
    docs = docs_of(list(enumerate(WORDS)))
    library = Tokenizer.from_file(VOCABULARY)
    pieces = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packing.token_pieces(docs, VOCABULARY).collect()}
    for i, text in enumerate(WORDS):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert pieces[i, 0] == (len(ids), zlib.crc32(ids.tobytes()))
    library = Tokenizer.from_file(WORD_VOCABULARY)
    folder = work_dir(spark, "records")
    records.write_tokens(docs, folder, WORD_VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in records.read_sequences(spark, folder).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(WORDS)}


def test_pieces_of_one_hash_in_one_chunk_and_in_two():
    def encode(pieces):
        return [[len(p), ord(p.strip()[0])] for p in pieces]

    together = pretokens.Pieces(encode)
    got = [x.tolist() for x in together.encode_chunk(WORDS)]
    apart = pretokens.Pieces(encode)
    assert got == [apart.encode_chunk([w])[0].tolist() for w in WORDS] == encode(WORDS)


@pytest.mark.parametrize("size", SIZES)
def test_op2_links_no_documents_without_common_shingles(docs_of, size):
    one, two = thue_morse(size), thue_morse(size, "b", "a")
    rows = [(1, f"{one} w1 w2 w3 w4"), (2, f"{two} w1 w2 w3 w4"), (3, f"{one} w1 w2 w3 w4"), (4, one), (5, two)]
    got = {r["doc_id"]: r["component_id"] for r in ngrams.near_duplicates(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_hashes_of_words_are_of_their_bytes_alone():
    words = ["a", "ab", "ab\0", "12345678", "123456789", "é" * 4, "x" * 64, "x" * 65, "\0", "\0\0", *WORDS]
    raw = [w.encode() for w in words]

    def hashed(texts):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        return ngrams._hashed(data, *ngrams._words(data)).tolist()

    one = hashed(raw)
    assert len(set(one)) == len(words)
    assert hashed(raw[::-1]) == one[::-1] and [hashed([w])[0] for w in raw] == one


def test_op3_and_op11_keep_structured_texts_apart(docs_of):
    texts = [thue_morse(n) + "-" * k + thue_morse(n, "b", "a") for n in (256, 1024) for k in (1, 300)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.removed(docs_of(rows)).collect()}
    assert got == dict(enumerate(brute.without_repeats(texts)))
    spaced = [" ".join(thue_morse(n)) for n in (512, 1024)]
    assert periods.runs_of(periods._numbers([s.encode() for s in spaced])) == [[], []]
