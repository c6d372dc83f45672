"""Results that are kept up to date by delivery, and runs that are put together."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from periodica.operators import partials, streaks
from periodica.operators.resolve import resolve_refs  # noqa: F401
from periodica.plans.sections import Archive, render
from periodica.sources import partials as stored
from periodica.sources import store as stores
from tests.test_documents import doc, entry

YEAR = 2006
RUN = ["creator_name", "first_period", "last_period", "streak_start", "streak_end", "streak_puzzles"]


def dated(spark, rows):
    return spark.createDataFrame(rows, "creator_name string, date date")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*RUN).collect())


@pytest.fixture(scope="module")
def dates():
    rng = random.Random(6)
    first = datetime.date(2003, 11, 1)
    return [
        (rng.choice("abc"), first + datetime.timedelta(days=rng.choice((7, 7, 7, 30)) * rng.randrange(70) + rng.randrange(9)))
        for _ in range(400)
    ]


@pytest.mark.parametrize("unit", list(streaks.UNITS))
def test_runs_of_any_parts_give_the_runs_of_all(spark, dates, unit):
    rng = random.Random(unit)
    whole = rows_of(streaks.period_runs(dated(spark, dates), unit))
    for parts in (2, 5):
        own = [[] for _ in range(parts)]
        for row in dates:
            own[rng.randrange(parts)].append(row)
        runs = [streaks.period_runs(dated(spark, rows), unit) for rows in own]
        left = right = None
        for r in runs:
            left = r if left is None else streaks.merged_runs(left.unionByName(r))
        for r in reversed(runs):
            right = r if right is None else streaks.merged_runs(r.unionByName(right))
        assert rows_of(left) == rows_of(right) == whole
    assert rows_of(streaks.merged_runs(streaks.period_runs(dated(spark, dates), unit))) == whole


def test_deliveries_that_lengthen_split_and_close(spark):
    def day(k):
        return datetime.date(2001, 1, 1) + datetime.timedelta(days=7 * k)

    def runs(*weeks):
        return streaks.period_runs(dated(spark, [("a", day(k)) for k in weeks]), "week")

    def merged(*parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return [(r[1] - r[2], r[3], r[4], r[5]) for r in rows_of(streaks.merged_runs(out))]

    assert merged(runs(0, 1), runs(2, 3)) == [(-3, day(0), day(3), 4)]
    assert merged(runs(0, 1, 4, 5), runs(3), runs(2)) == [(-5, day(0), day(5), 6)]
    assert merged(runs(0, 1), runs(3, 4)) == [(-1, day(0), day(1), 2), (-1, day(3), day(4), 2)]
    # A run inside another one, and dates of one week in two deliveries: the first counts.
    later = dated(spark, [("a", day(0) + datetime.timedelta(days=2)), ("a", day(2) + datetime.timedelta(days=1))])
    assert merged(runs(0, 1, 2), streaks.period_runs(later, "week")) == [(-2, day(0), day(2), 5)]
    best = streaks.longest_of(streaks.merged_runs(runs(0, 1).unionByName(runs(2))), "week").collect()
    assert [tuple(r) for r in best] == [("a", 3, day(0), day(2), 3)]


def put(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in docs))


def documents(seed, ids):
    rng = random.Random(seed)
    out = []
    for i in ids:
        entries = [
            entry(str(k), clue=rng.choice(["See 1", "Bird (4)", "", "Ann sings", " (6)"]),
                  direction=rng.choice(["across", "down", "slanted"]),
                  solution=rng.choice(["", "ROOK", "CROW", "OWL"]))
            for k in range(rng.randrange(4))
        ]
        day = 1_000_000_000_000 + 86_400_000 * rng.randrange(1500)
        out.append(doc(f"x/{i}", creator={"name": rng.choice(["Ann", "Bea", " "])}, date=day,
                       crosswordType=rng.choice(["cryptic", "prize", "quick"]), entries=entries))
    return out


def compared(spark, store):
    tables = stores.read_partials(spark, store)
    got = partials.sections(tables, YEAR)
    archive = Archive(stores.read_puzzles(spark, store), stores.read_entries(spark, store), YEAR)
    for name, want in render(archive).items():
        if name not in ("dup_answers", "dup_clues", "doc_links"):
            assert got[name].dtypes == want.dtypes, name
            assert list(map(tuple, got[name].collect())) == list(map(tuple, want.collect())), name


def test_sections_of_deliveries_equal_those_of_the_store(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    deliveries = [documents(1, range(0, 40)), documents(2, range(30, 70)), documents(3, range(60, 90))]
    for k, docs in enumerate(deliveries):
        put(tmp_path / f"in{k}", "a.json", docs)
        stores.import_documents(spark, store, [str(tmp_path / f"in{k}")], lines=True, with_partials=k != 1)
        if k != 1:
            continue
        # This delivery has no partial results: they are made from its rows when they are read.
        have = {r.batch for r in stored.stored(spark, f"{store}/partials", "answers").select("batch").distinct().collect()}
        assert have == {"import-000001"}
    assert partials.sections(stores.read_partials(spark, store), YEAR)["month_season"].agg({"n": "sum"}).first()[0] == 90
    stores.compact(spark, store)
    have = {r.batch for r in stored.stored(spark, f"{store}/partials", "answers").select("batch").distinct().collect()}
    assert have == {"compact-000001"}
    put(tmp_path / "in4", "a.json", documents(4, range(85, 120)))
    stores.import_documents(spark, store, [str(tmp_path / "in4")], lines=True, with_partials=True)
    compared(spark, store)


def test_a_delivery_reads_no_earlier_entries(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    store = str(tmp_path / "store")
    put(tmp_path / "one", "a.json", documents(1, range(20)))
    stores.import_documents(spark, store, [str(tmp_path / "one")], lines=True, with_partials=True)
    seen, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        seen.append((path, self._df.inputFiles()))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    put(tmp_path / "two", "a.json", documents(2, range(10, 30)))
    stores.import_documents(spark, store, [str(tmp_path / "two")], lines=True, with_partials=True)
    assert any("/partials/" in path for path, _ in seen)
    for path, files in seen:
        assert not any("/entries/batch=import-000001" in f or "/partials/" in f for f in files), path
        if "/partials/" in path:
            assert not any("import-000001" in f for f in files), path


def test_an_empty_store_has_empty_sections(spark, tmp_path):
    tables = stores.read_partials(spark, str(tmp_path / "none"))
    assert all(t.count() == 0 for t in tables.values())
    got = partials.sections(tables, YEAR)
    assert {n: df.count() for n, df in got.items() if df.count()} == {"debuts": 1, "month_season": 12}


def test_a_delivery_run_again_replaces_its_own(spark, tmp_path):
    folder = str(tmp_path / "partials")
    puzzles = spark.createDataFrame(
        [("1", "a", "cryptic", datetime.date(2004, 5, 6))], "id string, creator_name string, crossword_type string, date date"
    )
    entries = spark.createDataFrame(
        [("1", "ROOK", "Bird (4)", "across")], "crossword_id string, solution string, clue string, direction string"
    )
    for _ in range(2):
        stored.write(folder, "one", puzzles, entries)
    assert [r.n for r in stored.read(spark, folder)["answers"].collect()] == [1]
    assert stored.read(spark, folder, ["two"])["answers"].count() == 0
    assert stored.read(spark, folder)["publications"].where(F.col("last_date") == "2004-05-06").count() == 1
