"""Repeated answers and clues in their long form, also with a group of most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from periodica.operators import counts, tables, words
from periodica.operators.resolve import resolve_refs

BREAK = "<br />"


def archive(puzzles_of, entries_of, hot=0, seed=1):
    """Random uses; ``hot`` of all entries share setter, answer and clue."""
    rng = random.Random(seed)
    p = [(f"x/{i}", rng.choice("abc"), "2020-01-01", rng.choice(["cryptic", "prize"]))
         for i in range(60)]
    e = []
    for i in range(400):
        e.append((f"x/{rng.randrange(60)}", str(i), "across", f"Clue {rng.randrange(40)} (4)",
                  rng.choice(["", "ONE", "TWO", "THREE"])))
    heavy = [q[0] for q in p if q[1] == "a"]
    for i in range(hot):
        e.append((heavy[i % len(heavy)], str(1000 + i), "down", f"Heavy {i // len(heavy)} (4)", "HOT"))
        e.append((heavy[i % len(heavy)], str(9000 + i), "down", "Same heavy clue (4)", f"S{i}"))
    # A clue and answer repeated within one puzzle only.
    e += [(heavy[0], str(20000 + i), "down", f"Alone {i} (4)", "ALONE") for i in range(30)]
    return p, e, puzzles_of(p), entries_of(e)


def brute(p, e, by):
    info = {i: (s, i.split("/")[-1], k) for i, s, _, k in p}
    groups = defaultdict(set)
    for pid, _, _, clue, solution in e:
        setter, number, kind = info[pid]
        key = solution if by == "solution" else clue
        groups[setter, key].add((number, pid, clue, kind))
    return {k: sorted(v) for k, v in groups.items() if len({u[1] for u in v}) > 1}


def link(pid, number):
    return f'<a href="https://archive.example/{pid}">{number}</a>'


@pytest.mark.parametrize("hot", [0, 300])
def test_every_use_is_a_row_with_the_size_of_its_group(puzzles_of, entries_of, hot):
    p, e, pdf, edf = archive(puzzles_of, entries_of, hot)
    resolved = resolve_refs(edf.repartition(5))
    for build, by in ((words.dup_answers, "solution"), (words.dup_clues, "clue")):
        want = brute(p, e, by)
        rows = build(resolved, pdf).collect()
        got = defaultdict(list)
        for r in rows:
            got[r.creator_name, r[by]].append((r.number, r.crossword_id, r.clue, r.crossword_type))
            assert r.n_uses == len(want[r.creator_name, r[by]])
            assert r.link == link(r.crossword_id, r.number)
        assert dict(got) == want  # also in this order
        assert [(r.creator_name, r[by]) for r in rows] == sorted((r.creator_name, r[by]) for r in rows)


def test_form_does_not_change_with_size(puzzles_of, entries_of):
    small, large = (archive(puzzles_of, entries_of, n) for n in (0, 500))
    for build in (words.dup_answers, words.dup_clues):
        schemas = [build(resolve_refs(a[3]), a[2]).schema for a in (small, large)]
        assert schemas[0] == schemas[1]


def test_building_runs_no_job(spark, puzzles_of, entries_of):
    _, _, pdf, edf = archive(puzzles_of, entries_of)
    context = spark.sparkContext
    context.setJobGroup("building", "no job may run")
    resolved = resolve_refs(edf)
    words.dup_answers(resolved, pdf)
    words.dup_clues(resolved, pdf)
    counts.debuts(pdf, 2022)
    counts.debut_setters(pdf)
    for spec in tables.TABLES.values():
        tables.table_groups(spec, spec.rows(edf, pdf))
    assert len(context.statusTracker().getJobIdsForGroup("building")) == 0
    context.setLocalProperty("spark.jobGroup.id", None)


def test_references_count_as_uses_of_their_target(puzzles_of, entries_of):
    pdf = puzzles_of([("x/2", "a", "2020-01-01", "prize"), ("x/10", "a", "2020-01-01", "cryptic")])
    edf = entries_of([("x/2", "1", "across", "Bird (4)", "WREN"), ("x/2", "7", "down", "See 1", "WREN"),
                      ("x/10", "3", "down", "Small bird (4)", "WREN"),
                      ("x/10", "4", "down", "See 99", "WREN")])
    row = words.dup_answers(resolve_refs(edf), pdf, link_base="http://h/").collect()
    # "10" < "2" as text; the reference repeats its target's use; the lost one is gone.
    assert [tuple(r) for r in row] == [
        ("a", "WREN", 2, "10", "x/10", "Small bird (4)", "cryptic", '<a href="http://h/x/10">10</a>'),
        ("a", "WREN", 2, "2", "x/2", "Bird (4)", "prize", '<a href="http://h/x/2">2</a>'),
    ]


def test_debuts_of_a_crowded_year(puzzles_of):
    names = [f"s{i:03d}" for i in range(50)]
    pdf = puzzles_of([(n, n, "2020-01-01", "x") for n in names] + [("z", "zz", "2021-01-01", "x")])
    assert [tuple(r) for r in counts.debuts(pdf, 2022).collect()] == [(2020, 50), (2021, 1), (2022, 0)]
    assert [tuple(r) for r in counts.debut_setters(pdf).collect()] == [
        *((2020, n) for n in names), (2021, "zz"),
    ]


def test_pages_join_the_uses_of_their_groups(spark, puzzles_of, entries_of, tmp_path):
    p, e, pdf, edf = archive(puzzles_of, entries_of, 300)
    want = brute(p, e, "solution")
    spec = tables.TABLES["dup_answers"]
    page = tables.table_request("dup_answers", edf, pdf, str(tmp_path / "uses"), search="HOT", length=50)
    hits = {k: v for k, v in want.items() if "hot" in " ".join([*k, *(u[2] for u in v)]).lower()}
    assert (page.records_total, page.records_filtered) == (len(want), len(hits)) == (len(want), 1)
    (row,) = page.data.collect()
    uses = hits["a", "HOT"]
    assert tuple(row) == (
        "a", "HOT", BREAK.join(u[2] for u in uses), BREAK.join(u[3] for u in uses),
        BREAK.join(link(u[1], u[0]) for u in uses),
    )
    rows = spark.read.parquet(str(tmp_path / "uses"))
    groups = {tuple(r)[:2]: r for r in tables.table_groups(spec, rows).collect()}
    assert set(groups) == set(want)
    assert all(groups[k].n_uses == len(v) and groups[k].clues == v[0][2] for k, v in want.items())
    both = [F.col("creator_name") == "a", F.col("clue").startswith("Heavy")]
    assert [r.solution for r in tables.table_groups(spec, rows, both).collect()] == ["HOT"]
