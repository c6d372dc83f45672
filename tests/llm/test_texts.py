import base64
import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from periodica.llm import bpe, htmltext, packing, pii, pretokens, quality, sharding
from periodica.llm.queries import RANKS, VOCABULARY
from tests.llm import brute

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_are_those_of_the_library_and_decode_to_the_text(docs_of, hard_texts, encoding):
    rows = list(enumerate(hard_texts)) + [(7000, "<|endoftext|> don't can't'll 's x's\r\n\r\n  end  ")]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs_of(rows), RANKS).collect()}
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        )
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(docs_of(rows[:9]), RANKS).collect()}
    assert ids == {i: encoding.encode_ordinary(t or "") for i, t in rows[:9]}
    assert bpe.round_trip(docs_of(rows).limit(0), RANKS).count() == 0


def test_pieces_in_small_chunks(encoding, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 40)
    rng = random.Random(2)
    signs = "aAsStrevmldé'’ \n\t   12٣!?-_日本🙂́\r''   \x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(120))) for _ in range(3000)]
    replay = bpe.MergeReplay(bpe.read_ranks(RANKS))
    pieces = pretokens.Pieces(replay.encode, limit=500)
    held = [[] for _ in texts]
    for i, ids, _ in pretokens.encoded_texts(texts, pieces):
        held[i] += ids.tolist()
    assert held == [encoding.encode_ordinary(t) for t in texts]


def test_replay_equals_one_merge_at_a_time():
    """A rank file in which a late merge makes a pair of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abcd", b"ab", b"bcd", b"cd", b"aa", b"aaa", b"abc"]
    replay = bpe.MergeReplay({t: i for i, t in enumerate(tokens)})
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 15))) for _ in range(2000)]
    assert replay.encode(words) == [replay.encode_one(w.encode()) for w in words]


def test_a_packing_worker_stays_small():
    """Four million characters with many different words take a bounded part of a worker."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6):x}" for _ in range(700)) for _ in range(800)]
    texts.append(" ".join(texts[:200]))  # longer than a chunk
    tokenizer, _ = packing.coder(VOCABULARY)
    list(packing._encoded(["one"], VOCABULARY))  # tables that do not grow are there
    tracemalloc.start()
    for text, ids in zip(texts, packing._encoded(texts, VOCABULARY)):
        if len(text) > packing.CHUNK_CHARS or text is texts[0]:
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_pieces_of_documents_are_those_of_the_library(docs_of, hard_texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    rows = list(enumerate(hard_texts)) + [(900, "<|endoftext|>"), (901, "՘ ẞ \U0001fae8 new signs")]
    got: dict[int, list] = {}
    for r in packing.token_pieces(docs_of(rows), VOCABULARY, capacity=64).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        raw = [x.to_bytes(4, "little") for x in ids]
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        assert sorted(got[i]) == [
            (k, a, b - a, zlib.crc32(b"".join(raw[a:b]))) for k, (a, b) in enumerate(zip(edges, edges[1:]))
        ]


def test_sequences_are_full_and_without_gaps(spark, docs_of, hard_texts):
    rows = [(i, t) for i, t in enumerate(hard_texts * 3)] + [(None, "x"), (None, "x")]
    packed = packing.pack(packing.token_pieces(docs_of(rows), VOCABULARY, 512), 512).collect()
    assert len({(r["doc_id"], r["piece"]) for r in packed}) >= len(hard_texts) * 3
    total = 0
    by_sequence: dict[int, list] = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= 1.02 * total / 512 + 2
    empty = packing.pack(packing.token_pieces(docs_of(rows).limit(0), VOCABULARY))
    assert empty.count() == 0


def test_sweeps_use_few_sequences():
    rng = random.Random(6)
    sizes = Counter(min(99, int(rng.expovariate(1 / 30)) + 1) for _ in range(20_000))
    runs, made = packing.sweeps(dict(sizes), 100)
    assert sum(r[2] for r in runs) == 20_000
    least = sum(s * n for s, n in sizes.items()) / 100
    assert made <= 1.01 * max(least, sum(n for s, n in sizes.items() if s > 50)) + 1
    assert packing.sweeps({}, 100) == ([], 0)


def test_quality_measures_are_those_of_brute_force(docs_of, hard_texts):
    rows = list(enumerate(hard_texts)) + [(None, "a b"), (None, "a b")]
    judged = quality.judged(docs_of(rows))
    got = {r["doc_id"]: r for r in judged.collect()}
    for i, text in rows:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(got[i][n] for n in names) == brute.quality(text)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert judged.count() == len(rows)
    assert quality.judged(docs_of(rows).limit(0)).count() == 0


def test_hosts_are_judged_by_shrunk_rates(docs_of):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad" if i % 10 else good, "rotten") for i in range(100)]
    rows += [(1000 + i, "bad" if i % 10 == 0 else good, f"host{i % 5}") for i in range(500)]
    rows += [(5000, "bad", "single"), (5001, good, None), (5002, good, "single")]
    docs = docs_of(rows)
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    assert not any(got[i] for i in range(100))
    assert all(got[1000 + i] == (i % 10 != 0) for i in range(500))
    assert got[5001] and got[5002] and not got[5000]
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_base_spans_are_those_of_brute_force(docs_of):
    rng = random.Random(8)
    signs = list("0123456789") * 3 + list("....---  ++@@ab()_%\n") + ["4111111111111111", "10.0.0.1", "a@b.c", "+1 (234) 555-2485"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "0000255.1.1.1 256.1.1.1 1.1.1.99999999999999999999"]
    texts += ["7" * 20_000 + " 4" * 8_000, "x" * 50_000 + "@", "é🙂 4111 1111-1111 1111 é +1 2345678901"]
    found = pii.with_spans(docs_of(list(enumerate(texts))), keep_text=False)
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", pii.spans_text("base").alias("t")).collect()}
    assert got == {i: brute.spans_text(brute.base_spans(t)) for i, t in enumerate(texts)}


def test_contexts_discover_other_forms(docs_of):
    rows = [(i, f"please call me: +1 (555) 010-{1000 + i} thanks") for i in range(12)]
    rows += [(100 + i, f"pages {i} to {i + 3} of 1234567{i}") for i in range(12)]
    rows += [(200, "Please  Call me: 555-010-4242 soon"), (201, "it is 555-010-4242 again"), (202, "isbn 978-3-16-148410-0")]
    docs = docs_of(rows)
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in pii.with_spans(docs).collect()}
    assert found[200] == [(3, "555-010-4242")] and found[201] == [(3, "555-010-4242")]
    assert all(not found[100 + i] for i in range(12)) and not found[202]
    done = pii.redacted_documents(docs)
    assert done.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in done.collect()}
    assert texts[200] == "Please  Call me: <PHONE> soon" and texts[0] == "please call me: <PHONE> thanks"
    assert pii.with_spans(docs.limit(0)).count() == 0


def test_contexts_chain_until_nothing_is_new(docs_of):
    """Pattern k is trusted only with what the patterns before it discover."""
    rows, levels = [], 6
    for k in range(levels):
        shown = [f"+1 (555) 020-{1000 + i}" for i in range(12)]
        shown += [f"555-010-{1000 + i}" for i in range(3 * k + 3)]
        rows += [(len(rows) + i, f"word{k} is: {value} now") for i, value in enumerate(shown)]
    found = pii.with_spans(docs_of(rows)).collect()
    assert all([s["kind"] for s in r["spans"]] == [3] for r in found) and len(found) == len(rows)


def test_long_words_and_addresses_are_whole(docs_of):
    long, name = "w" * 90, "n" * 80 + "é"
    rows = [(i, f"a{i} {long} {'v' * 70}: +1 (555) 010-{1000 + i}") for i in range(12)]
    rows += [(100, f"b {long} {'v' * 70}: 555-020-4242"), (101, f"b x{long} {'v' * 70}: 555-020-4343")]
    rows += [(200 + i, f"mail to: a{i}@b.example") for i in range(12)]
    rows += [(300, f"mail to: {name}@{'h' * 300} now"), (301, "x" * 300_000 + " 1234567" + "y" * 300_000)]
    got = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in pii.with_spans(docs_of(rows)).collect()}
    assert got[100] == ["555-020-4242"] and got[101] == [] and got[301] == []
    assert got[300] == [f"{name}@{'h' * 300}"]


def test_shards_are_of_equal_size_and_gapless(spark, docs_of, tmp_path):
    rng = random.Random(9)
    rows = [(i if i % 3 else None, "x" * int(rng.expovariate(1 / 300))) for i in range(3000)]
    rows += [(7, None), (7, None), (8, "")]
    path = str(tmp_path / "map")
    out = sharding.shard_documents(docs_of(rows), map_path=path).collect()
    assert len(out) == len(rows)
    loads, places = Counter(), {}
    for r in out:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(40))
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 40 + 20
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    text = {r[0]: r[1] or "" for r in rows[-1:]}
    row = next(r for r in out if r["doc_id"] == 8 and r["size"] == 16)
    assert row["text_crc32"] == zlib.crc32(text[8].encode())
    assert {r["version"] for r in sharding.read_map(spark, path, 0).select("version").distinct().collect()} == {0}
    assert sharding.read_map(spark, path).where("version <> 1").count() == 0
    assert sharding.shard_documents(docs_of(rows).limit(0)).count() == 0


def test_equal_rows_are_spread_and_the_map_is_kept(spark, docs_of, tmp_path):
    docs = docs_of([(None, "the same") for _ in range(2500)] + [(i, "x" * 8) for i in range(2500)])
    path = str(tmp_path / "map")
    for version in (1, 2):
        out = sharding.shard_documents(docs, map_path=path).collect()
        loads, places = Counter(r["shard"] for r in out), Counter((r["shard"], r["slot"]) for r in out)
        assert len(out) == 5000 and max(places.values()) == 1
        assert max(loads.values()) - min(loads.values()) <= 2
        assert max(Counter(r["virtual_slot"] for r in out).values()) <= 10
        kept = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, version).collect()}
        assert len(kept) == sharding.SLOTS and all(kept[r["virtual_slot"]] == r["shard"] for r in out)


def test_a_rebalance_moves_few_slots(spark):
    totals = spark.range(400).selectExpr("cast(id as int) as virtual_slot", "1L as n_rows", "100 + id % 7 as n_bytes")
    first = sharding.rebalanced(sharding.first_map(spark, 10, 400), totals, 10).cache()
    grown = sharding.rebalanced(first, totals, 11)
    old = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    new = {r["virtual_slot"]: r["shard"] for r in grown.collect()}
    moved = [s for s in old if old[s] != new[s]]
    assert 30 <= len(moved) <= 60 and {r["version"] for r in grown.collect()} == {2}
    loads = Counter(new.values())
    assert max(loads.values()) - min(loads.values()) <= 2


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{margin:0}}</style>
<script>var t="</p><article>no</article>";</script></head><body><nav><ul><li><a href="/a">A{n}</a></li></ul></nav>
<div class="ad">Buy {n}</div>{main}<aside>More {n}</aside><div id="comments-list"><p>I disagree {n}</p></div>
<form><p>Name</p></form><footer>&copy; {n}</footer></body></html>"""


def test_articles_of_several_layouts(spark):
    rows, want = [], {}
    layouts = {
        "a.example": "<article><h1>T &amp; {n}</h1><p><b>one\n two{n}<br>x</b><p>three &lt;{n}<div class=notice>Sign up</div></article>",
        "b.example": "<div class='body'><h2>T &amp; {n}</h2><p>one\t two{n} x</p><p>three &lt;{n}</p></div><div class='strip'>Same words</div>",
        "c.example": "<main><header>H{n}</header><section><p>T &amp; {n}</p></section><p>one two{n} x<li>three &lt;{n}</main>",
    }
    for host, main in layouts.items():
        for k in range(6):
            n = len(rows)
            rows.append((n, f"https://{host}:8080/p?{k}", PAGE.format(n=n, main=main.format(n=n)), "x"))
            want[n] = f"T & {n}\none two{n} x\nthree <{n}"
    rows += [(90, None, None, "x"), (91, "no address", "", "x"), (92, "https://one.example/", "plain &eacute; text", "x")]
    want |= {90: "", 91: "", 92: "plain é text"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r["text"] for r in htmltext.main_texts(pages).collect()}
    assert got == want
    assert htmltext.main_texts(pages.limit(0)).count() == 0


def test_equal_pages_keep_their_article(spark):
    html = "<body><nav>menu</nav><article><p>the same everywhere</p></article></body>"
    pages = spark.createDataFrame([(i % 4, "http://h/", html) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.main_texts(pages).collect()} == {"the same everywhere"}
    assert htmltext.main_texts(pages).count() == 9


def texts_of_pages(spark, htmls):
    rows = [(i, "https://h.example/p", html) for i, html in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in htmltext.main_texts(pages).orderBy("page_id").collect()]


def test_copies_of_a_page_keep_all_of_its_article(spark):
    """Copies are one page, also where only what is around the article differs."""
    html = (
        "<body><nav>menu {n}</nav><article><h1>T</h1><p>a</p><ul><li>x</li></ul><table><tr><td>y</table>"
        "<section><p>z</p></section></article><footer>{n}</footer></body>"
    )
    want = "T\na\nx\ny\nz"
    assert texts_of_pages(spark, [html.format(n=1)] * 5 + [html.format(n=n) for n in range(5)]) == [want] * 10
    # The same words on different pages are still the host's own.
    other = "<article><h1>T{n}</h1><p>a{n}</p><ul><li>x</li></ul></article>"
    assert texts_of_pages(spark, [other.format(n=n) for n in range(4)]) == [f"T{n}\na{n}" for n in range(4)]


def test_layouts_of_few_pages_have_templates(spark):
    """Slots on the same pages are a layout, whose words that never change are no article."""
    usual = "<div class=body><p>text {n}</p></div>"
    rare = "<div class=strip><p>Same words</p></div><div class=story><p>long story {n}</p></div>"
    got = texts_of_pages(spark, [usual.format(n=n) for n in range(12)] + [rare.format(n=n) for n in range(4)])
    assert got == [f"text {n}" for n in range(12)] + [f"long story {n}" for n in range(4)]


def test_pages_without_article_tags_keep_every_slot(spark):
    html = (
        "<body><div class=top><a href=/>to page {n}</a></div><div class=content><h1>Title {n}</h1>"
        "<div class=text><p>text {n}, the longest of the slots</p></div><div class=strip>Same words</div>"
        "<div class=more><p>more {n}</p></div>{once}</div><div class=sidebar>side {n}</div></body>"
    )
    pages = [html.format(n=n, once="<div class=note>once</div>" * (n == 2)) for n in range(6)]
    want = [f"Title {n}\ntext {n}, the longest of the slots\nmore {n}" + "\nonce" * (n == 2) for n in range(6)]
    assert texts_of_pages(spark, pages) == want
    apart = "<div class=b-a>one {n}</div><div class=b>two {n}</div><div class=b>three {n}<div class=c>four {n}</div></div>"
    want = [f"one {n}\ntwo {n}\nthree {n}\nfour {n}" for n in range(6)]
    assert texts_of_pages(spark, [apart.format(n=n) for n in range(6)]) == want


@pytest.mark.parametrize("depth", [0, 39, 40, 41, 45, 3000])
def test_containers_at_any_depth_are_known(depth):
    deep = "<div>" * depth
    html = f"{deep}<nav>menu</nav><article><p>a</p><div><aside><div>b</div></aside></div><ul><li>c</ul></article><p>d</p>"
    found = [(path, text) for path, text, _ in htmltext.blocks(html + "</div>" * depth + "<p>e</p>")]
    assert [text for path, text in found if htmltext.APART not in path] == ["a", "c", "d", "e"]
    assert [text for path, text in found if htmltext.tagged(path)] == ["a", "b", "c"]
    assert len({path for path, _ in found}) == 6 - (depth == 0) and max(len(path) for path, _ in found) < 400
    assert htmltext.article(html, {}) == "a\nc"


def test_queries_equal_their_sql(spark):
    from tests.compare import connect, differences, oracle_result, spark_result

    con = connect(FOLDER)
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            got = spark_result(entry.queries()[name](spark, FOLDER))
            assert differences(got, oracle_result(con, sql)) == []
