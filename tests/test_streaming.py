"""Documents arriving over time give the tables a batch import gives."""

import json

from periodica.operators import ingest
from periodica.schemas import ENTRIES, PUZZLES
from periodica.sources import documents
from periodica.sources.store import compact, import_documents
from periodica.streaming import ingest as stream
from tests.test_documents import doc, entry


def put(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))


def run(spark, folder, store, per_batch=1):
    docs = stream.document_stream(spark, str(folder), lines=True, files_per_batch=per_batch)
    stream.stream_ingest(docs, str(store), str(store / "mark")).awaitTermination()
    return (
        stream.read_puzzles(spark, str(store)).select(*PUZZLES.names),
        stream.read_entries(spark, str(store)).select(*ENTRIES.names),
    )


def many(lo, hi, name="first"):
    return [doc(f"x/{i}", name=name, entries=[entry(str(j)) for j in range(i % 4)])
            for i in range(lo, hi)]


def test_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    inbox, store = tmp_path / "in", tmp_path / "store"
    put(inbox, "1.json", many(0, 20) + ["{broken"])
    put(inbox, "2.json", many(20, 30))
    p, e = run(spark, inbox, store)
    assert (p.count(), e.count()) == (30, sum(i % 4 for i in range(30)))

    # A later delivery repeats known documents with other contents.
    put(inbox, "3.json", many(10, 40, "second"))
    p, e = run(spark, inbox, store)
    assert {r.name for r in p.where("id in ('x/10', 'x/29')").collect()} == {"first"}
    assert p.count() == 40 and p.select("id").distinct().count() == 40

    scanned = documents.stage(
        documents.scan_json(spark, roots=[str(inbox)], lines=True), str(tmp_path / "staged")
    )
    good, bad = documents.quarantine(scanned)
    first = documents.first_documents(good)
    assert sorted(documents.puzzle_norm(first).collect(), key=str) == sorted(p.collect(), key=str)
    assert sorted(documents.entry_explode(first).collect()) == sorted(e.collect())
    assert bad.count() == spark.read.parquet(str(store / "rejected")).count() == 1

    again, _ = run(spark, inbox, store)
    assert again.count() == 40


def test_a_replayed_batch_replaces_its_first_try(spark, tmp_path):
    """A batch that fails after writing its puzzles is run again under the same id."""
    inbox, store = tmp_path / "in", tmp_path / "store"
    put(inbox, "1.json", many(0, 8))
    run(spark, inbox, store)
    # Forget that the batch was committed: the engine will replay it.
    commits = store / "mark" / "commits"
    assert [f.name for f in commits.iterdir() if not f.name.startswith(".")] == ["0"]
    for f in commits.iterdir():
        f.unlink()
    p, e = run(spark, inbox, store)
    assert (p.count(), e.count()) == (8, sum(i % 4 for i in range(8)))


def test_entries_without_their_puzzles_stay_hidden(spark, tmp_path):
    inbox, store = tmp_path / "in", tmp_path / "store"
    put(inbox, "1.json", many(0, 8))
    p, e = run(spark, inbox, store)
    late = e.limit(3)
    late.write.parquet(str(store / "entries" / "batch=stream-000007"))
    assert stream.read_entries(spark, str(store)).count() == e.count()


def test_the_first_folder_wins_in_a_stream_too(spark, tmp_path):
    put(tmp_path / "b", "1.json", many(0, 6, "first"))
    put(tmp_path / "a", "1.json", many(0, 9, "second"))
    docs = stream.document_stream(spark, [str(tmp_path / "b"), str(tmp_path / "a")], lines=True)
    store = tmp_path / "store"
    stream.stream_ingest(docs, str(store), str(store / "mark")).awaitTermination()
    names = [r.name for r in stream.read_puzzles(spark, str(store)).orderBy("id").collect()]
    assert names == ["first"] * 6 + ["second"] * 3
    assert not (store / "work" / "stream-000000").exists()


def test_imports_and_compaction(spark, tmp_path):
    one, two, store = tmp_path / "one", tmp_path / "two", str(tmp_path / "store")
    put(one, "1.json", many(0, 6, "first") + ["{broken"])
    put(two, "1.json", many(3, 9, "second"))
    assert import_documents(spark, store, [str(one)], lines=True) == "import-000001"
    assert import_documents(spark, store, [str(one), str(two)], lines=True) == "import-000002"
    import_documents(spark, store, files=[str(two / "1.json")], lines=True)

    def state():
        return (
            sorted((r.id, r.name) for r in stream.read_puzzles(spark, store).collect()),
            sorted(tuple(r)[:-1] for r in stream.read_entries(spark, store).collect()),
        )

    before = state()
    assert [n for _, n in before[0]] == ["first"] * 6 + ["second"] * 3
    assert len(before[1]) == sum(i % 4 for i in range(9))
    # A delivery that failed before its puzzles landed, and is run again.
    spark.read.parquet(f"{store}/entries/batch=import-000001").write.parquet(f"{store}/entries/batch=import-000004")
    assert state() == before
    name = compact(spark, store)
    assert state() == before
    assert {r.batch for r in stream.read_puzzles(spark, store).collect()} == {name}
    assert compact(spark, store) != name and state() == before


def test_nothing_stored_yet(spark, tmp_path):
    assert stream.read_puzzles(spark, str(tmp_path / "none")).count() == 0
    assert ingest.append_new(
        spark.createDataFrame([("1",)], "id string"),
        stream.read_puzzles(spark, str(tmp_path / "none")),
    ).count() == 1


def test_first_rows_name_the_first_document_of_an_id(spark):
    from periodica.sources.store import first_rows

    rows = [("a", 1, ["f"], 0, 7), ("a", 0, ["g"], 0, 9), ("a", 0, ["g"], 0, 8), (None, 0, ["f"], 0, 3), ("", 0, ["f"], 0, 2)]
    docs = spark.createDataFrame(rows, "id string, source_rank int, source_path array<string>, source_at long, row long")
    assert sorted(tuple(r) for r in first_rows(docs).collect()) == [("", 2), ("a", 8)]
