"""Repair of conversations to a legal order of roles, at the least cost.

A legal conversation has an optional system message and then pairs of a user's and an
assistant's message, or nothing at all.  The rows of a damaged one are kept, given another
role or deleted, and empty messages are put in.  These edits are the edges of a lattice whose
nodes say how many rows are done and what role came last.  Two searches run through it, one
from its start and one from its end, each with a heap of the nearest open nodes; they go on
until no path through open nodes of both can be as cheap as the cheapest crossing found, so
every node of every cheapest path is known to one of them.  The audit, an initial for each
edit, is then the least in ASCII order among all cheapest paths, read off from the start: an
initial leads from a node to one other node only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from periodica.llm.common import text_batches

# What edits cost, and what a truncated row costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# The ends of whole sentences, and white space.
STOPS = ".!?"
WHITE = " \t\n\x0b\x0c\r"

# What came last: nothing, a system message, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# The search of a conversation of at most so many rows is remembered by its rows' kinds.
REMEMBERED = 64

AUDITS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)
_AUDITS = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
     ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPAIRED = "conv_id long, position long, role string, text string, edit string, turn long"
_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()),
     ("edit", pa.string()), ("turn", pa.int64())]
)


def _next(last: int) -> int:
    return ASSISTANT if last == USER else USER


# A row's kind: its role's initial, in upper case if it is truncated; "-" if it must go.
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _moves(kinds: str, node: tuple[int, int]) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """(initial, cost, node) of the edits that lead on from a node, in ASCII order."""
    i, last = node
    row = kinds[i] if i < len(kinds) else ""
    if row:
        yield "D", DELETE, (i + 1, last)
    yield "I", INSERT, (i, _next(last))
    if row and row != "-":
        more = 0 if row.islower() or row == "?" else TRUNCATED
        role = _INITIAL.get(row.lower())
        if role == _next(last) or (role == SYSTEM and last == NOTHING):
            yield "K", more, (i + 1, role)
        yield "R", REROLE + more, (i + 1, _next(last))


def _moves_back(kinds: str, node: tuple[int, int]) -> Iterator[tuple[int, tuple[int, int]]]:
    """(cost, node) of the edits that lead to a node."""
    i, last = node
    before = {NOTHING: (), SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}[last]
    if last in ROLES:
        for b in before:
            yield INSERT, (i, b)
    if not i:
        return
    row = kinds[i - 1]
    yield DELETE, (i - 1, last)
    if row == "-":
        return
    more = 0 if row.islower() or row == "?" else TRUNCATED
    role = _INITIAL.get(row.lower())
    for b in before:
        if role == last:
            yield more, (i - 1, b)
        if last in ROLES:
            yield REROLE + more, (i - 1, b)


def _search(kinds: str) -> tuple[int, str]:
    """The least cost, and the least audit of that cost."""
    n = len(kinds)
    source, goals = (0, NOTHING), ((n, NOTHING), (n, ASSISTANT))
    near = ({source: 0}, dict.fromkeys(goals, 0))  # the least cost known from, and to
    done: tuple[set, set] = (set(), set())
    heaps = ([(0, source)], [(0, g) for g in goals])
    heapq.heapify(heaps[1])
    best = 0 if source in goals else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        way = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heapq.heappop(heaps[way])
        if node in done[way]:
            continue
        done[way].add(node)
        steps = ((c, to) for _, c, to in _moves(kinds, node)) if way == 0 else _moves_back(kinds, node)
        mine, other = near[way], near[1 - way]
        for step, to in steps:
            if cost + step < mine.get(to, cost + step + 1):
                mine[to] = cost + step
                heapq.heappush(heaps[way], (cost + step, to))
            if to in other and (best is None or cost + step + other[to] < best):
                best = cost + step + other[to]
    # What is left to pay from each node of a cheapest path: known to the reverse search, or
    # for what only the forward search has done, carried back from the crossings.
    left = {v: near[1][v] for v in done[1]} | dict.fromkeys(goals, 0)
    ahead = sorted(done[0], key=lambda v: (-near[0][v], -v[0]))
    for v in ahead:
        if v not in left:
            rest = best - near[0][v]
            if any(left.get(to) == rest - cost for _, cost, to in _moves(kinds, v)):
                left[v] = rest
    audit, node = [], source
    while left[node] or node not in goals:
        for initial, cost, to in _moves(kinds, node):
            if left.get(to) == left[node] - cost:
                audit.append(initial)
                node = to
                break
    return best, "".join(audit)


_remembered = lru_cache(maxsize=20_000)(_search)


def cheapest(kinds: str) -> tuple[int, str]:
    """The cost and the audit of the cheapest repair of rows of these kinds."""
    return _remembered(kinds) if len(kinds) <= REMEMBERED else _search(kinds)


def _faults(rows: list[tuple[int | None, str, str]]) -> str:
    """The first fault of each row (b, d or t), or a point."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in STOPS else "t")
        seen.add((role, text))
    return "".join(out)


def _kinds(rows: list[tuple[int | None, str, str]], faults: str) -> str:
    out = []
    for (_, role, _), fault in zip(rows, faults):
        initial = role[:1] if role[:1] in _INITIAL else "?"
        stays = initial if fault == "." else (initial.upper() if initial != "?" else "!")
        out.append("-" if fault in "bd" else stays)
    return "".join(out)


def _repaired(rows, audit: str) -> Iterator[tuple[str, str, str, int | None]]:
    """(role, text, edit, turn) of the messages that an audit makes of the rows."""
    given, last = iter(rows), NOTHING
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        last = _INITIAL[role[0]] if edit == "K" else _next(last)
        yield role if edit == "K" else ROLES[last], text, edit, turn


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list]]:
    """(conv_id, rows of turn, role, text) of conversations whose rows stand together."""
    held: list = []
    rows: list[tuple[int | None, str, str]] = []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there"))
        for conv, turn, role, text, there in zip(*columns):
            if not held or held[0] != conv:
                if held:
                    yield held[0], rows
                held, rows = [conv], []
            if there:
                rows.append((turn, role, text))
    if held:
        yield held[0], rows


def _together(rows: DataFrame, every: DataFrame | None) -> DataFrame:
    """Rows side by side by conversation, in order; the ids of `every` without being rows."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), spaced("role"), spaced("text"),
        F.lit(True).alias("there"),
    )
    if every is not None:
        given = given.union(
            every.select(F.col("conv_id").cast("bigint")).distinct().selectExpr(
                "conv_id", "cast(null as bigint)", "' '", "' '", "false"
            )
        )
    text_batches(rows.sparkSession)
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def audit_conversations(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation: its faults, the cheapest repair and the digest of its outcome.

    rows: conv_id, turn, role, text; other columns are dropped.  A null role or text counts
    as one space.  Rows go by turn (null ones first), then role and text, so the order is
    one and the same on every run; equal rows are duplicates of the first.  Rows with a null
    conv_id are one conversation.  `every` names ids that get a row even if they have no
    rows: zeros, an empty audit and the digest of an empty text.  An empty table gives an
    empty one.  A task holds the rows of one conversation at a time, which are no longer
    than what they are repaired to, one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(_AUDITS)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _AUDITS)], schema=_AUDITS
            )

        for conv, found in _conversations(batches):
            faults = _faults(found)
            turns = {t for t, _, _ in found if t is not None}
            initials = [role[:1] for _, role, _ in found]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            cost, audit = cheapest(_kinds(found, faults))
            digest, between = hashlib.sha256(), ""
            for role, text, _, _ in _repaired(found, audit):
                digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            out.append(
                (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest.hexdigest())
            )
            if len(out) >= 1000:
                yield flush()
        if out:
            yield flush()

    return _together(rows, every).mapInArrow(run, AUDITS)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired messages: conv_id, position, role, text, edit and the turn they come from.

    edit is the initial of Keep, Rerole or Insert; an inserted message has no turn.  Rows are
    taken as `audit_conversations` takes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _REPAIRED)], schema=_REPAIRED
            )

        for conv, found in _conversations(batches):
            _, audit = cheapest(_kinds(found, _faults(found)))
            for k, message in enumerate(_repaired(found, audit)):
                out.append((conv, k, *message))
                if len(out) >= 1000:
                    yield flush()
        if out:
            yield flush()

    return _together(rows, None).mapInArrow(run, REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of `conv_id:turn`; nulls are one space.

    Of twenty rows one is dropped, one emptied, one without its sentence ends, one said
    twice, and one has the role of a user.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = (
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", ""))
        .otherwise(spaced("text"))
    )
    return (
        rows.withColumn("_kind", kind)
        .where("_kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(spaced("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )
