import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from periodica.llm import dialogue

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
CONVERSATIONS = "conv_id long, turn long, role string, text string, cost string, there string"
NOTHING = hashlib.sha256(b"").hexdigest()


def plain_repair(rows):
    """rows: (role, text, fault) -> (cost, audit, messages), over all states, one row at a time."""
    legal = re.compile(r"(s?(ua)+)?")

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value
            return True
        return False

    # State: the last role's initial, "" before any.  Values: cost, audit, messages.
    def inserted(table):
        for _ in range(3):  # a second insert after a first one, and what that makes better
            for last, (cost, audit, out) in list(table.items()):
                to = "a" if last == "u" else "u"
                role = "assistant" if to == "a" else "user"
                better(table, to, (cost + 2, audit + "I", [*out, (role, "")]))
        return table

    # Suffixes are best compared from the end, so the rows are taken from the last to the first.
    end = {last: (0, "", []) for last in ("", "a")}

    def before(table):
        for _ in range(3):
            for last in ("", "s", "u", "a"):
                to = "a" if last == "u" else "u"
                if to in table:
                    cost, audit, out = table[to]
                    role = "assistant" if to == "a" else "user"
                    better(table, last, (cost + 2, "I" + audit, [(role, ""), *out]))
        return table

    table = before(end)
    for role, text, fault in reversed(rows):
        new = {}
        for last in ("", "s", "u", "a"):
            if last in table:
                cost, audit, out = table[last]
                better(new, last, (cost + 3, "D" + audit, out))
            if fault in "bd":
                continue
            more = 1 if fault == "t" else 0
            to = "a" if last == "u" else "u"
            if to in table:
                cost, audit, out = table[to]
                name = "assistant" if to == "a" else "user"
                better(new, last, (cost + 2 + more, "R" + audit, [(name, text), *out]))
            for initial in (role[:1],):
                if initial in table and (initial == to or (initial == "s" and last == "")):
                    cost, audit, out = table[initial]
                    better(new, last, (cost + more, "K" + audit, [(role, text), *out]))
        table = before(new)
    cost, audit, out = table[""]
    assert legal.fullmatch("".join(r[:1] for r, _ in out))
    return cost, audit, out


def exhaustive(rows, most=3):
    """The same by trying every edit of every row, and every way of inserting up to `most`."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None
    options = []
    for role, _, fault in rows:
        own = [("D", "", 3)]
        if fault not in "bd":
            more = 1 if fault == "t" else 0
            own += [("K", role[:1] or "?", more), ("R", "u", 2 + more), ("R", "a", 2 + more)]
        options.append(own)
    fills = [f for k in range(most + 1) for f in itertools.product("ua", repeat=k)]
    for choice in itertools.product(*options):
        for fill in itertools.product(fills, repeat=len(rows) + 1):
            if sum(map(len, fill)) > most:
                continue
            roles, audit = "".join(fill[0]), "I" * len(fill[0])
            for (edit, made, _), more in zip(choice, fill[1:]):
                roles += made + "".join(more)
                audit += edit + "I" * len(more)
            if legal.fullmatch(roles):
                found = (sum(c for _, _, c in choice) + 2 * sum(map(len, fill)), audit)
                best = found if best is None else min(best, found)
    return best


def plain_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        if not words:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("." if words[-1] in ".!?" else "t")
        seen.add((role, text))
    return "".join(out)


def plain_audit(rows):
    """rows (turn, role, text) of one conversation -> the columns of op13 but the id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = plain_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    cost, audit, out = plain_repair([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def plain_damage(rows):
    """(conv_id, turn, role, text) rows -> {conv_id: rows left}."""
    left = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        own = left.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return left


ROLES = ("user", "assistant", "system", "tool", "", "admin")


def test_searches_equal_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        n = rng.randrange(11)
        rows = [(rng.choice(ROLES[: rng.choice((2, 3, 6))]), "x", rng.choice("....tbd")) for _ in range(n)]
        kinds = dialogue._kinds([(0, r, t) for r, t, _ in rows], "".join(f for _, _, f in rows))
        cost, audit, out = plain_repair(rows)
        assert dialogue._search(kinds) == (cost, audit), rows
        made = [(r, t) for r, t, _, _ in dialogue._repaired([(0, r, t) for r, t, _ in rows], audit)]
        assert made == out


def test_brute_force_equals_all_edits():
    for n in range(3):
        for rows in itertools.product([("user", "", "."), ("assistant", "", "t"), ("system", "", "."), ("tool", "", "b")], repeat=n):
            cost, audit, _ = plain_repair(list(rows))
            assert (cost, audit) == exhaustive(list(rows)), rows


def test_a_long_conversation():
    kinds = "su" + "au" * 20_000 + "-?Ua"
    cost, audit = dialogue._search(kinds)
    assert len(audit) == len(kinds) + audit.count("I") and cost <= 9


def messy(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            role = rng.choice(("system", "tool", None, "")) if rng.random() < 0.1 else role
            text = rng.choice(("Yes.", "No!", "Why", "", " \n", None, "Long text? ", "日本。", "ok.\x0b"))
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, text))
    return rows + rows[:40]


def test_audits_equal_brute_force(spark):
    rows = messy(random.Random(4), 400)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVERSATIONS).repartition(3)
    got = {tuple(r) for r in dialogue.audit_conversations(dialogue.damaged(table), every=table).collect()}
    want = {(conv, *plain_audit(left)) for conv, left in plain_damage(rows).items()}
    assert got == want and any(r[1:] == (0,) * 6 + ("", NOTHING) for r in want)
    assert dialogue.audit_conversations(table.limit(0), every=table.limit(0)).count() == 0
    assert dialogue.repair_conversations(table.limit(0)).count() == 0


def test_repaired_messages(spark):
    rows = [
        (1, 0, "system", "Be brief.", "", ""), (1, 1, "user", "Why?", "", ""), (1, 2, "user", "Why?", "", ""),
        (1, 4, "assistant", "So it is", "", ""), (2, 0, "assistant", "Hello.", "", ""),
    ]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    got = sorted(tuple(r) for r in dialogue.repair_conversations(table).collect())
    assert got == [
        (1, 0, "system", "Be brief.", "K", 0), (1, 1, "user", "Why?", "K", 1), (1, 2, "assistant", "So it is", "K", 4),
        (2, 0, "user", "", "I", None), (2, 1, "assistant", "Hello.", "K", 0),
    ]
    audits = {r["conv_id"]: (r["cost"], r["audit"], r["gaps"], r["duplicate"], r["truncated"]) for r in dialogue.audit_conversations(table).collect()}
    assert audits == {1: (4, "KKDK", 1, 1, 1), 2: (2, "IK", 0, 0, 0)}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in entry.queries()["op13_edit_lattice"](spark, FOLDER).collect()}
    assert got == {(conv, *plain_audit(left)) for conv, left in plain_damage(rows).items()}
