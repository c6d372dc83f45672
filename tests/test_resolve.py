"""Cross-reference resolution, case by case."""

import pytest

from periodica.operators.resolve import resolve_refs

REAL5, REAL5D = "Five across (5)", "Five down (5)"


def clue_of_one(entries_of, ref, targets, match="prefix"):
    rows = [("p", "1", "across", ref, "A")] + [("p", n, d, c, "T") for n, d, c in targets]
    found = resolve_refs(entries_of(rows), match=match).where("entry_id = '1-across'").collect()
    return [r.clue for r in found]


BOTH = [("5", "across", REAL5), ("5", "down", REAL5D)]


@pytest.mark.parametrize(
    "ref, targets, prefix, full",
    [
        ("See 5", [("5", "across", REAL5)], [REAL5], [REAL5]),
        ("See 5", [("5", "across", "See 9"), ("5", "down", REAL5D)], [REAL5D], [REAL5D]),
        ("See 5", BOTH, [REAL5], [REAL5]),
        ("See 5", [], [], []),
        ("See 5", [("5, 21", "across", REAL5)], [], []),
        ("See 5 down", BOTH, [REAL5D], ["See 5 down"]),
        ("See 5 Down", BOTH, [REAL5], ["See 5 Down"]),
        ("See 5 (6)", [("5", "across", REAL5)], [REAL5], ["See 5 (6)"]),
        ("See special instructions (7)", BOTH, ["See special instructions (7)"],) * 1
        + (["See special instructions (7)"],),
        ("See 5 across", [("5", "down", REAL5D)], [], ["See 5 across"]),
        ("See 5", [("5", "across", "See 9"), ("9", "down", REAL5D)], ["See 9"], ["See 9"]),
    ],
)
def test_cases(entries_of, ref, targets, prefix, full):
    assert clue_of_one(entries_of, ref, targets) == prefix
    assert clue_of_one(entries_of, ref, targets, "full") == full


def test_other_columns_stay_the_referring_entrys(entries_of):
    rows = [("p", "1", "across", "See 5", "MINE"), ("p", "5", "down", REAL5D, "THEIRS")]
    row = resolve_refs(entries_of(rows)).where("entry_id = '1-across'").first()
    assert (row.solution, row.direction, row.human_number, row.clue) == (
        "MINE", "across", "1", REAL5D,
    )


def test_other_puzzles_are_not_looked_at(entries_of):
    rows = [("p", "1", "across", "See 5", "A"), ("q", "5", "down", REAL5D, "B")]
    assert [r.crossword_id for r in resolve_refs(entries_of(rows)).collect()] == ["q"]


def test_never_more_rows_even_in_a_crowded_puzzle(entries_of):
    """One puzzle holds many targets of one number and many references to it."""
    rows = [("p", "5", "down", f"Clue {i} (5)", f"S{i}") for i in range(300)]
    rows = [(p, n, d, c, s) for p, n, d, c, s in rows]
    rows += [("p", str(i), "across", "See 5", "R") for i in range(100, 400)]
    got = resolve_refs(entries_of(rows)).where("direction = 'across'").collect()
    assert len(got) == 300
    # Equal direction and entry id: the smallest clue decides.
    assert {r.clue for r in got} == {"Clue 0 (5)"}
