"""N-gram Jaccard join by parity sketches.

A document is its set of five-word shingles.  Every shingle is hashed to one of the parts
of a sketch, and the word of a part is the exclusive-or of its shingles' hashes: sets that
differ in d shingles differ in at most d parts.  For a similarity of 0.8 a set of a shingles
may differ from its partner in a quarter of a, so that of a/4 + 1 parts that hold a shingle
at least one is equal in both (equal empty parts do not count on either side).  These words
are the keys of an equality join inside bands of set sizes, and of each set's keys the a/4 + 1
that the fewest sets have are enough.  A second sketch of single
parity bits, whose Hamming distance is also at most d, throws out nearly all candidates that
are not similar before the sets themselves are compared.

Documents of equal sets are one node.  A node is first compared with the smallest of all
that it shares a key with, then with the smallest of each key, and the links are drawn
together into components.  While components that share keys remain, every node is compared
with the node of each of its keys that has the smallest share of shingles that no other
component has, the least changed of near copies.  When that draws nothing more together, nodes
that share a key but are in different components still are compared with each other, unless
the shingles that only their own components have are too many already.  So no link between
components is missed, and neither a group of copies nor a passage in many different texts
costs the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.llm.common import put_back, set_aside, staged, text_batches
from periodica.llm.components import components
from periodica.llm.hashing import mixed

WORDS = 5
# Documents link when 100 x common >= 80 x all.
SIMILAR = 80
# A sketch has a power of two of bits, at least as many as this, and twice the set's size.
LEAST_BITS = 512
# A band of sizes from 2^j to 2.5 x 2^j has a part for this share of its largest size, and
# some more for short texts.
PARTS, MORE_PARTS = 0.3, 4
# Turns in which nodes are compared with the centres of their keys; what they leave is compared
# with each other.
TURNS = 4
# So many keys of a node tell where it has met another one already.
HEAD_KEYS = 16
CHUNK = 1 << 20
FILTER_BITS = 25

SKETCHES = "doc_id long, n_shingles long, node long, sketch array<long>"
_LIST = pa.list_(pa.int64())


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    white = (data == 0x20) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


# Longer words are hashed one by one.
LONG_WORD = 64


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: eight bytes a step, mixed before the next ones come.

    The mixing is a bijection, so words of up to eight bytes and one length never collide,
    and no polynomial stands behind the others whose zeros a word could be made of.
    """
    size = end - start
    out = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    eights = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    left = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(left):
        value = eights[start[left] + done].copy().view("<u8").ravel()
        spare = np.maximum(8 - (size[left] - done), 0).astype(np.uint64) * np.uint64(8)
        value &= np.uint64(2**64 - 1) >> spare
        out[left] = mixed((out[left] ^ value) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(done + 1))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def _salted(words: np.ndarray, k: int) -> np.ndarray:
    return mixed(words + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of lower-cased texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, end = _words(data)
    none = np.zeros(0, dtype=np.int64)
    if not len(start):
        return none, none.astype(np.uint64)
    owner = np.searchsorted(ends, start, side="right")
    word = _hashed(data, start, end)
    n = len(start)
    whole = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, n)):  # the hash of the words from here on, in one text
        same = owner[: n - k] == owner[k:]
        whole[: n - k] += np.where(same, _salted(word[k:], k), np.uint64(0))
    # A shingle begins where its last word is in the same text, or at the text's first word.
    full = np.zeros(n, dtype=bool)
    if n >= words:
        full[: n - words + 1] = owner[: n - words + 1] == owner[words - 1 :]
    first = np.ones(n, dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    take = full | first
    owner, whole = owner[take], mixed(whole[take] + (~full[take]).astype(np.uint64))
    order = np.lexsort((whole, owner))
    owner, whole = owner[order], whole[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
    return owner[new], whole[new]


def _keys(owner: np.ndarray, item: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, info) of the keys of all parts in use; size: of the texts' sets, owner in order.

    info has the band and seed, how many parts are in use, and how many keys are needed.
    """
    floor = np.zeros(len(size), dtype=np.int64)
    positive = size > 0
    floor[positive] = np.floor(np.log2(size[positive])).astype(np.int64)
    may_differ = (size + size * 5 // 4) // 9
    found: list[tuple[np.ndarray, ...]] = []
    for shift in (0, 1):  # the band that begins at this size, and the one before
        band = floor - shift
        member = positive & (band >= 0) & (2 * size < 5 * 2.0**band)
        parts = np.ceil(PARTS * 2.5 * 2.0**band).astype(np.int64) + MORE_PARTS
        poor, seed = member, 0
        while (active := poor[owner]).any():
            o, x = owner[active], mixed(item[active] ^ np.uint64(seed * 0x5851F42D4C957F2D + 1 & (2**64 - 1)))
            part = ((x >> np.uint64(40)) * parts[o].astype(np.uint64) >> np.uint64(24)).astype(np.int64)
            order = np.lexsort((part, o))
            o, part, x = o[order], part[order], x[order]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            word = np.bitwise_xor.reduceat(x, at)
            o, part = o[at], part[at]
            used = np.bincount(o, minlength=len(size))
            needed = np.minimum(used, may_differ + 1)
            place = (band[o] << 40 | seed << 32 | part).astype(np.uint64)
            info = (band[o] * 16 + seed) << 48 | used[o] << 24 | needed[o]
            found.append((o, mixed(mixed(word) ^ mixed(place)), info))
            # With fewer parts in use than the guarantee needs, once more with other parts:
            # a pair is found by the first seed under which either has enough.
            poor = poor & (used <= may_differ)
            seed += 1
            if seed > 3:
                parts = parts * 2
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    return tuple(np.concatenate(c) for c in zip(*found))


def _split(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as lower-cased bytes, in groups of bounded size; a null one is empty."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) > CHUNK:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    owner, item = shingles(texts, words)
    size = np.bincount(owner, minlength=len(texts))
    total = np.zeros(len(texts), dtype=np.uint64)
    np.add.at(total, owner, mixed(item ^ np.uint64(0xD6E8FEB86659FD93)))
    node = mixed(total + size.astype(np.uint64))
    return owner, item, size, node


def _width(size: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(2 * size, LEAST_BITS))).astype(np.int64)


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (the hash of the set) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in _groups(batch.column("text").to_pylist()):
                n = len(texts)
                owner, item, size, node = _sets(texts, words)
                width = _width(size)
                first = np.cumsum(width) - width
                bit = first[owner] + (item & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
                bits = np.bincount(bit, minlength=int(width.sum())) & 1
                sketch = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n),
                        pa.array(size, pa.int64()),
                        pa.array(node.view(np.int64)),
                        _split(sketch, np.repeat(np.arange(n), width // 64), n),
                    ],
                    ["doc_id", "n_shingles", "node", "sketch"],
                )

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SKETCHES)


def join_keys(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, node, info) of the keys of all sets; equal sets of one task have theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in _groups(batch.column("text").to_pylist()):
                owner, item, size, node = _sets(texts, words)
                wanted = _unseen(node, size > 0, seen)[owner]
                found, keys, info = _keys(owner[wanted], item[wanted], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(node[found].view(np.int64)), pa.array(info)],
                    ["key", "node", "info"],
                )

    return docs.select("text").mapInArrow(run, "key long, node long, info long")


def _unseen(node: np.ndarray, of: np.ndarray, seen: set[int]) -> np.ndarray:
    """Flags of the first of each node; adds them to those seen."""
    new = of.copy()
    for i in np.flatnonzero(of).tolist():
        key = int(node[i])
        new[i] = key not in seen
        seen.add(key)
    return new


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit for every value of the nodes' low bits: at most 4 MB, whatever their number."""
    low = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (
        nodes.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    for word, bits in words:
        out[word] = bits & (2**64 - 1)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, items): the sets of the given nodes, and of some others that nothing asks for.

    The texts are read where they are, and a filter of fixed size tells which sets may be
    wanted, so that neither texts nor other sets are shuffled.  A set may come once from
    each task.
    """
    filtered = docs.sparkSession.sparkContext.broadcast(_filter_of(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in _groups(batch.column("text").to_pylist()):
                owner, item, size, node = _sets(texts, words)
                low = node & np.uint64((1 << FILTER_BITS) - 1)
                bits = filtered.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))
                take = _unseen(node, ((bits & np.uint64(1)) > 0) & (size > 0), seen)
                kept = take[owner]
                place = np.cumsum(take) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[take].view(np.int64)),
                        _split(item[kept], place[owner[kept]], int(take.sum())),
                    ],
                    ["node", "items"],
                )

    return docs.select("text").mapInArrow(run, "node long, items array<long>")


def _folded(sketch: str, other: str) -> Column:
    """A sketch as narrow as the other one; halves fold into each other by parity."""
    half = F.size(sketch).cast("int") / 2
    fold = F.zip_with(
        F.slice(sketch, F.lit(1), half.cast("int")),
        F.slice(sketch, (half + 1).cast("int"), half.cast("int")),
        lambda x, y: x.bitwiseXOR(y),
    )
    return F.when(F.size(sketch) > F.size(other), fold).otherwise(F.col(sketch))


def _near(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity.

    Sizes that do so are at most a quarter apart, so widths differ by one fold at most.
    """
    for side in ("a", "b"):
        pairs = pairs.join(
            meta.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side
        )
    pairs = pairs.where(SIMILAR * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b"))
    for side in ("a", "b"):
        pairs = pairs.join(meta.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.withColumns(
        {"_a": _folded("sketch_a", "sketch_b"), "_b": _folded("sketch_b", "sketch_a")}
    )
    distance = F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    # At most d = (a + b)(100 - s) / (100 + s) shingles differ.
    return pairs.where(
        (100 + SIMILAR) * distance <= (100 - SIMILAR) * (F.col("n_a") + F.col("n_b"))
    ).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    every = F.size("items_a") + F.size("items_b") - common
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(100 * common >= SIMILAR * every)
        .select("a", "b")
        .distinct()
    )


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _labelled(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components so far."""
    for side in ("a", "b"):
        names = joined.select(F.col("node").alias(side), F.col("component").alias(f"component_{side}"))
        pairs = pairs.join(names, side, "left").withColumn(
            f"component_{side}", F.coalesce(f"component_{side}", side)
        )
    return pairs.where("component_a <> component_b").select("a", "b")


def _open_keys(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, component) of the keys that nodes of different components share."""
    placed = shared.join(joined, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    return _across(placed).select("key", "node", "component")


def _across(rows: DataFrame) -> DataFrame:
    """The rows whose key is in several components."""
    several = (
        rows.groupBy("key")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"))
        .where("first <> last")
        .select("key")
    )
    return rows.join(several, "key")


def _allowance(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n_shingles, own, room): the shingles of its component alone, and what they allow.

    nodes: node and component of all that are to be compared; sets: theirs, once each.  What
    only a component has is missing in every node of another one.  Two similar sets of a and
    b shingles have at least (a + b) s / (100 + s) in common, so that 100 + s times those of
    a that b lacks are at most 100 a - s b.  Two nodes of different components are similar
    only if s times the size of each is at most the room of the other one.
    """
    items = nodes.join(sets, "node").select("node", "component", F.explode("items").alias("item"))
    alone = (
        items.groupBy("item")
        .agg(F.min("component").alias("first"), F.max("component").alias("last"))
        .where("first = last")
        .select("item")
    )
    counted = items.join(alone, "item").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = nodes.select("node").join(sets, "node").select("node", F.size("items").cast("bigint").alias("n_shingles"))
    own = F.coalesce("own", F.lit(0)).cast("bigint")
    return (
        sizes.join(counted, "node", "left")
        .withColumn("own", own)
        .withColumn("room", 100 * F.col("n_shingles") - (100 + SIMILAR) * F.col("own"))
    )


def _may_link(x: str, y: str) -> Column:
    """Whether the sizes of two nodes, and what their components alone have, allow a link."""
    fits = lambda a, b: SIMILAR * F.col(f"{a}.n_shingles") <= F.col(f"{b}.room")
    return (F.col(f"{x}.component") != F.col(f"{y}.component")) & fits(x, y) & fits(y, x)


def _centre_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a node and the centre of one of its keys, in different components.

    rows: those of _open_keys, with the allowance.  The centre is the node with the smallest
    share of shingles that only its component has.
    """
    share = F.col("own") / F.col("n_shingles")
    centre = F.struct(share.alias("share"), "node", "component", "n_shingles", "room")
    centres = rows.groupBy("key").agg(F.min(centre).alias("y"))
    met = rows.alias("x").join(centres, "key").where(_may_link("x", "y"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs without those tried, whichever node of these comes first."""
    for a, b in (("a", "b"), ("b", "a")):
        pairs = pairs.join(tried.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
    return pairs


def _short(meta: DataFrame) -> DataFrame:
    """node, n_shingles and the sketch folded to LEAST_BITS, a column for each 64 of them."""
    n = LEAST_BITS // 64
    fold = lambda j: F.aggregate(
        F.filter("sketch", lambda _, i: i % n == j), F.lit(0).cast("bigint"), lambda all, x: all.bitwiseXOR(x)
    )
    return meta.select("node", "n_shingles", *[fold(j).alias(f"s{j}") for j in range(n)])


def _open_pairs(rows: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs of nodes that share a key but no component, and that may be similar.

    rows: those of _open_keys, with the allowance.  A node that not even the smallest set and
    the largest room of its key allow leaves the key before nodes meet, so a passage that
    many texts share, each with much text of its own beside it, costs its rows and not their
    square.  What meets is tried by size, room and short sketch where it meets, and becomes a
    row at the first key that both have, not at each of them.
    """
    limits = rows.groupBy("key").agg(F.min("n_shingles").alias("least"), F.max("room").alias("most"))
    fits = (SIMILAR * F.col("least") <= F.col("room")) & (SIMILAR * F.col("n_shingles") <= F.col("most"))
    rows = staged(_across(rows.join(limits, "key").where(fits).drop("least", "most")), "open-rows")
    heads = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, HEAD_KEYS).alias("heads"))
    # A pair has met before if both have one of these keys; at its first one it has not.
    rows = rows.join(short.drop("n_shingles"), "node").join(heads, "node")
    rows = rows.withColumn("before", F.expr("filter(heads, k -> k < key)")).drop("heads")
    rows = staged(rows, "open-sketches")
    mine, other = rows.alias("x"), rows.alias("y")
    words = [c for c in short.columns if c.startswith("s")]
    distance = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in words)
    sizes = F.col("x.n_shingles") + F.col("y.n_shingles")
    meets = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.node") < F.col("y.node"))
        & _may_link("x", "y")
        & ((100 + SIMILAR) * distance <= (100 - SIMILAR) * sizes)
        & ~F.arrays_overlap("x.before", "y.before")
    )
    return mine.join(other, meets).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _shared(keys: DataFrame) -> DataFrame:
    """The keys that several nodes have, with how often they occur."""
    same = Window.partitionBy("key")
    return (
        keys.withColumns(
            {
                "low": F.min("node").over(same),
                "high": F.max("node").over(same),
                "times": F.count(F.lit(1)).over(same),
            }
        )
        .where("low <> high")
        .select("key", "node", "info", "times")
        .distinct()
    )


def _rarest(keys: DataFrame) -> DataFrame:
    """The keys that are needed of each node: the rarest ones, those of it alone first.

    Of n keys two similar sets share n - d at least, in either's count; so their rarest
    common key is among the d + 1 rarest of both.  A set of which most keys are its own
    needs none, and what very many sets have in common comes last.
    """
    own = Window.partitionBy("node", F.shiftright("info", 48))
    used, needed = (F.shiftright("info", n).bitwiseAND(F.lit((1 << 24) - 1)) for n in (24, 0))
    chosen = keys.withColumns(
        {
            "rank": F.row_number().over(own.orderBy("times", "key")),
            "n_shared": F.count(F.lit(1)).over(own),
        }
    ).where(F.col("rank") <= needed - used + F.col("n_shared"))
    same = Window.partitionBy("key")
    return chosen.withColumns(
        {"low": F.min("node").over(same), "high": F.max("node").over(same)}
    ).where("low <> high")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    component_id is the smallest doc_id among the documents that links lead to.  A document
    without words, or without text, is linked with nothing and is its own component, as is
    one of fewer than five words with equal ones only.  Null ids are kept: such a row alone
    has a null component.  Repeated rows are equal documents.  Other columns are dropped; an
    empty table gives an empty one.  Shingles and sets are told apart by 64-bit hashes.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = staged(sketched(docs, words), "sketches")
    meta = base.where("n_shingles > 0").select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    meta = staged(meta, "nodes")
    shared = _rarest(staged(_shared(join_keys(docs, words)), "shared-keys"))
    shared = staged(shared.select("key", "node", "low"), "rarest-keys")

    # Every node with the smallest one of each of its keys; first with the smallest of all.
    stars = shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    stars = staged(_near(meta, stars), "stars")
    sets = staged(sets_of(docs, staged(_nodes(stars), "star-nodes"), words), "sets")
    first = staged(stars.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    links = staged(_linked(first, sets), "first-links")
    joined = components(links)
    rest = stars.join(first, ["a", "b"], "left_anti")
    rest = staged(_labelled(rest, joined), "second-pairs")
    links = links.union(staged(_linked(rest, sets), "second-links"))
    joined = components(links)

    # What shares a key and is in different components still; components only grow, so there
    # is less of it each time.
    open_keys, tried = shared, stars
    for turn in range(TURNS + 1):
        open_keys = staged(_open_keys(open_keys.select("key", "node"), joined), "open-keys")
        open_nodes = staged(open_keys.select("node", "component").distinct(), "open-nodes")
        if turn == 0:
            missing = open_nodes.select("node").join(_nodes(stars), "node", "left_anti")
            more = sets_of(docs, staged(missing, "other-nodes"), words)
            open_sets = sets.union(more).join(open_nodes, "node", "left_semi").dropDuplicates(["node"])
            open_sets = staged(open_sets, "open-sets")
        rows = open_keys.join(staged(_allowance(open_nodes, open_sets), "allowance"), "node")
        if turn == TURNS:
            break
        pairs = staged(_near(meta, _untried(_centre_pairs(rows), tried)), "centre-pairs")
        found = staged(_linked(pairs, open_sets), "centre-links")
        tried = tried.union(pairs)
        if found.isEmpty():
            break
        links = links.union(found)
        joined = components(links)

    # All that is left.
    short = staged(_short(meta.join(open_nodes, "node", "left_semi")), "short-sketches")
    others = staged(_near(meta, _untried(_open_pairs(rows, short), tried)), "others")
    if not others.isEmpty():
        found = staged(_linked(others, open_sets), "other-links")
        if not found.isEmpty():
            joined = components(links.union(found))

    placed = base.select("doc_id", "n_shingles", "node").join(joined, "node", "left")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    placed = staged(placed.select("doc_id", "n_shingles", group.alias("group")), "placed")
    names = placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    names = staged(names, "components")
    return placed.join(names, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, all columns as they were, one row for each component.

    The row with the smallest doc_id stays (a null one last), the first of repeated rows.
    Where every row has an id of its own, that tells rows apart; otherwise they are numbered,
    which takes a copy of them.
    """
    unclear = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if unclear.isEmpty():
        found = near_duplicates(docs, words).where("doc_id <> component_id")
        gone = staged(found.select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    rows = set_aside(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows, "numbered")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words).select(
        F.col("doc_id").alias("_row"), "component_id"
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    crowds = found.groupBy("component_id").count().where("count > 1").select("component_id")
    crowded = found.join(crowds, "component_id").join(rows.select("_row", "doc_id"), "_row")
    crowded = staged(crowded, "crowded")
    first = crowded.groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    gone = staged(crowded.select("_row").join(first, "_row", "left_anti"), "gone")
    return put_back(rows.join(gone, "_row", "left_anti"), docs.columns)
