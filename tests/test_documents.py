"""Reading, normalising, de-duplicating and storing generated documents."""

import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from periodica.operators import ingest
from periodica.schemas import ENTRIES, PUZZLES
from periodica.sources import documents, sinks

D = datetime.date


def entry(n="1", direction="across", **kw):
    return {"id": f"{n}-{direction}", "number": int(n), "humanNumber": n, "clue": f"Clue {n} (3)",
            "direction": direction, "length": 3, "position": {"x": 1, "y": 2},
            "separatorLocations": {",": [1]}, "group": [f"{n}-{direction}"], "solution": "ABC", **kw}


def doc(id_, **kw):
    full = {"id": id_, "number": 17, "name": "No 17", "creator": {"name": "Ann", "webUrl": "http://a"},
            "date": 1164326400000, "crosswordType": "cryptic", "entries": [entry()]}
    full.update(kw)
    return {k: v for k, v in full.items() if v is not ...}


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=4))


def scan(spark, tmp_path, *roots, **kw):
    scanned = documents.scan_json(spark, roots=[str(r) for r in roots], **kw)
    return documents.stage(scanned, str(tmp_path / f"staged{random.random()}"))


def normal(spark, tmp_path, document):
    put(tmp_path / "in" / "a.JSON", document)
    good, bad = documents.quarantine(scan(spark, tmp_path, tmp_path / "in"))
    assert bad.count() == 0
    return documents.puzzle_norm(good).first(), documents.entry_explode(good).collect()


def test_plain_document(spark, tmp_path):
    p, e = normal(spark, tmp_path, doc("x/17"))
    assert tuple(p) == ("x/17", "17", "No 17", "Ann", "http://a", D(2006, 11, 24), "cryptic", None)
    assert [tuple(r) for r in e] == [
        ("x/17", "1-across", 1, "1", "Clue 1 (3)", "across", 3, "ABC", 1, 2)
    ]


@pytest.mark.parametrize(
    "change, column, value",
    [
        ({"creator": ...}, "creator_name", "Unknown"),
        ({"creator": None}, "creator_name", "Unknown"),
        ({"creator": {"name": ""}}, "creator_name", "Unknown"),
        ({"creator": {"name": "  "}}, "creator_name", ""),
        ({"creator": {"name": "A \t"}}, "creator_name", "A"),
        ({"creator": {"name": " A\n"}}, "creator_name", " A\n"),
        ({"creator": {"name": "A"}}, "creator_weburl", "http://www.example.org"),
        ({"date": ...}, "date", D(1970, 1, 1)),
        ({"date": 1.1643264e12}, "date", D(2006, 11, 24)),
        ({"date": -1}, "date", D(1969, 12, 31)),
        ({"number": ...}, "number", "<nil>"),
        ({"number": None}, "number", "<nil>"),
        ({"number": "17a"}, "number", "17a"),
        ({"pdf": "http://p"}, "pdf", "http://p"),
        ({"pdf": ""}, "pdf", ""),
        ({"name": ...}, "name", ""),
        ({"crosswordType": ...}, "crossword_type", ""),
        ({"id": ...}, "id", ""),
    ],
)
def test_missing_and_odd_fields(spark, tmp_path, change, column, value):
    p, _ = normal(spark, tmp_path, doc("x", **change))
    assert p[column] == value


def test_entries_with_gaps(spark, tmp_path):
    p, e = normal(spark, tmp_path, doc("x", entries=[{}, entry(solution=None)]))
    assert tuple(e[0]) == ("x", "", 0, "", "", "", 0, "", 0, 0)
    assert e[1].solution == ""


@pytest.mark.parametrize("entries", [[], None, ...])
def test_no_entries(spark, tmp_path, entries):
    p, e = normal(spark, tmp_path, doc("x", entries=entries))
    assert p.id == "x" and e == []


def test_bad_files_do_not_stop_the_others(spark, tmp_path):
    root = tmp_path / "in"
    put(root / "a.json", doc("good"))
    put(root / "b.Json", json.dumps(doc("cut"))[:-5])
    put(root / "c.JSON", doc("mistyped", entries=[entry(number="one")]))
    put(root / "d.JSON", doc("mistyped date", date="soon"))
    put(root / "e.txt", doc("not looked at"))
    good, bad = documents.quarantine(scan(spark, tmp_path, root, tmp_path / "missing"))
    assert [r.id for r in documents.puzzle_norm(good).select("id").collect()] == ["good"]
    names = sorted(r.source_path[-1] for r in bad.collect())
    assert names == ["b.Json", "c.JSON", "d.JSON"]


GOOD = json.dumps(doc("x"))


@pytest.mark.parametrize(
    "text, reason",
    [
        (GOOD, None),
        (f" \n{GOOD}\n\t", None),
        (GOOD + GOOD, "not one JSON object"),
        (GOOD + " junk", "not one JSON object"),
        (GOOD + "]", "not one JSON object"),
        (GOOD + "," + GOOD, "not one JSON object"),
        (f"[{GOOD}]", "not one JSON object"),
        ("", "not one JSON object"),
        ("3", "not one JSON object"),
        (json.dumps(doc("x", solutionAvailable=3, group=5, dateSolutionAvailable=1.16e12)), None),
        (json.dumps(doc("x", separatorLocations="none")), None),
        (json.dumps(doc(5)), "wrong type"),
        (json.dumps(doc("x", name={"q": 1})), "wrong type"),
        (json.dumps(doc("x", creator="Ann")), "wrong type"),
        (json.dumps(doc("x", entries=[entry(clue=1)])), "wrong type"),
        (json.dumps(doc("x", entries=[entry(length=1.5)])), "wrong type"),
        (json.dumps(doc("x", entries=[None])), None),
        (json.dumps(doc("x", date=1e19)), "no such date"),
        (json.dumps(doc("x", date=-1e300)), "no such date"),
    ],
)
def test_what_is_accepted(spark, text, reason):
    row = documents.parse_json(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["_reject_reason"] == reason
    assert row["_corrupt_record"] == (text if reason else None)
    assert row["id"] == (None if reason else "x")


def test_keys_in_any_case(spark):
    text = '{"ID":"x","Name":"a","NAME":"b \\"id\\": 1","ENTRIES":[{"Clue":"c","POSITION":{"X":3}}]}'
    row = documents.parse_json(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.id, row.name, row.entries[0].clue, row.entries[0].position.x) == ("x", 'b "id": 1', "c", 3)


def test_nothing_to_read(spark, tmp_path):
    none = documents.scan_json(spark, roots=[str(tmp_path / "missing")])
    good, bad = documents.quarantine(none)
    assert documents.puzzle_norm(good).schema == PUZZLES or documents.puzzle_norm(good).count() == 0
    assert bad.count() == 0


def test_first_copy_in_walk_order_wins(spark, tmp_path):
    first, second = tmp_path / "cryptic", tmp_path / "prize"
    put(second / "a" / "1.JSON", doc("same", name="later folder"))
    # By component "a" sorts before "a-b", though "a-b/1" < "a/1" as text.
    put(first / "a-b" / "1.JSON", doc("same", name="later path"))
    put(first / "a" / "1.JSON", doc("same", name="first"))
    put(first / "b c+d" / "1.JSON", doc("other"))
    docs = documents.first_documents(scan(spark, tmp_path, first, second))
    assert {r.id: r.name for r in docs.collect()} == {"same": "first", "other": "No 17"}


def test_listed_files_win_in_list_order(spark, tmp_path):
    for folder in "abc":
        put(tmp_path / f"{folder} x" / "1.json", doc("same", name=folder))
    files = [str(tmp_path / f"{f} x" / "1.json") for f in "cab"]
    docs = documents.scan_json(spark, files=files)
    assert documents.first_documents(docs).first().name == "c"
    assert docs.count() == 3


def test_lines_and_files_agree(spark, tmp_path):
    many = [doc(f"x/{i}", entries=[entry(str(j)) for j in range(i % 3)]) for i in range(20)]
    for i, d in enumerate(many):
        put(tmp_path / "files" / f"{i}.json", d)
    put(tmp_path / "lines" / "all.json", "\n".join(map(json.dumps, many)))
    one = scan(spark, tmp_path, tmp_path / "files")
    two = scan(spark, tmp_path, tmp_path / "lines", lines=True)
    for build in (documents.puzzle_norm, documents.entry_explode):
        assert sorted(build(one).collect()) == sorted(build(two).collect())


def test_import_twice_changes_nothing(spark, tmp_path):
    many = [doc(f"x/{i}") for i in range(10)]
    put(tmp_path / "in" / "all.json", "\n".join(map(json.dumps, many[:6])))
    first = documents.first_documents(scan(spark, tmp_path, tmp_path / "in", lines=True))
    stored = documents.puzzle_norm(first)
    assert ingest.append_new(first, stored).count() == 0
    put(tmp_path / "in" / "more.json", "\n".join(map(json.dumps, many)))
    again = documents.first_documents(scan(spark, tmp_path, tmp_path / "in", lines=True))
    assert sorted(r.id for r in ingest.append_new(again, stored).collect()) == [
        f"x/{i}" for i in range(6, 10)
    ]


def test_dedupe_with_one_key_holding_most_rows(spark):
    rows = [(f"k{i % 3}" if i % 4 == 0 else "hot", i, f"v{i}") for i in range(2000)]
    random.Random(2).shuffle(rows)
    got = ingest.dedupe_first_wins(
        spark.createDataFrame(rows, "k string, at int, v string").repartition(7), "k", ["at"]
    )
    want = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, v)
    assert {r.k: r.v for r in got.collect()} == want


def test_integrity(spark, puzzles_of, entries_of):
    p = puzzles_of([("1", "a", "2020-01-01", "x"), ("1", "b", "2020-01-01", "x"),
                    ("2", "b", "2020-01-01", "x")])
    e = entries_of([("2", "1", "across", "c", "S"), ("9", "1", "across", "c", "S"),
                    ("9", "2", "across", "c", "S")])
    assert sorted(map(tuple, ingest.integrity_check(p, e).collect())) == [
        ("duplicate", "1", 2), ("orphan", "9", 2),
    ]


def test_stored_tables_read_back(spark, tmp_path):
    many = [doc(f"x/{i}", date=1e12 + i * 4e9, pdf=None if i % 2 else "p",
                entries=[entry(str(j)) for j in range(i % 4)]) for i in range(30)]
    put(tmp_path / "in" / "all.json", "\n".join(map(json.dumps, many)))
    docs = scan(spark, tmp_path, tmp_path / "in", lines=True)
    p, e = documents.puzzle_norm(docs), documents.entry_explode(docs)
    sinks.write_puzzles(p, str(tmp_path / "p"))
    sinks.write_entries(e, str(tmp_path / "e"))
    back = sinks.read_puzzles(spark, str(tmp_path / "p"))
    assert back.select(*p.columns).schema == PUZZLES
    assert sorted(map(str, back.select(*p.columns).collect())) == sorted(map(str, p.collect()))
    stored = sinks.read_entries(spark, str(tmp_path / "e"))
    assert stored.schema == ENTRIES and sorted(stored.collect()) == sorted(e.collect())


def test_row_file_keeps_html_and_missing_values(spark, tmp_path):
    df = spark.createDataFrame([("<a href=\"x\">é & 'b'</a>", 1), (None, 2)], "a string, b int")
    sinks.sink_rows_json(df, str(tmp_path / "rows"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "rows")).collect())
    assert [json.loads(x) for x in lines] == [["<a href=\"x\">é & 'b'</a>", "1"], [None, "2"]]
    assert "<a href" in lines[0]
    back = sinks.read_rows_json(spark, str(tmp_path / "rows"), ["a", "b"])
    assert sorted(map(str, back.collect())) == sorted(
        map(str, df.select("a", F.col("b").cast("string").alias("b")).collect())
    )


def test_plain_texts_are_read_in_one_step(spark):
    """Texts that the short way takes, and texts that must go the long way, with their outcome."""
    from periodica.functions.json import plain_keys
    from periodica.schemas import OTHER_NAMES, TEXT_NAMES

    plain = ['{"id":"1","name":null,"number":5}', ' {"id" : "1", "other":{"a":[1]}}\n', '{"entries":[{"id":"a","number":1}]}']
    odd = {
        '{"Id":"1"}': None, '{"id":5}': "wrong type", '{"i\\u0064":5}': "wrong type", "{'id':5}": "wrong type",
        '{"entries":[null]}': None, '{"entries":[{"id" : 7}]}': "wrong type",
    }
    closing = ['{}{}', '{},{}', '{}],"x":[{}', '{}],"_periodica_mark":[{}', '{},{"_periodica_mark":"1"}],"x":[{}', '[{}]', '{}]']
    texts = spark.createDataFrame([(t,) for t in [*plain, *odd, *closing]], "value string").withColumn("key", F.col("value"))
    taken = texts.where(plain_keys(F.col("value"), TEXT_NAMES, OTHER_NAMES))
    taken = {r.key for r in taken.collect()}
    assert set(plain) <= taken and not taken & set(odd)
    reasons = {r.key: r._reject_reason for r in documents.parse_json(texts, "value").collect()}
    assert reasons == {**dict.fromkeys(plain), **odd, **dict.fromkeys(closing, "not one JSON object")}


def test_first_documents_move_asked_columns_only(spark, tmp_path):
    put(tmp_path / "in/a.json", {"id": "1", "name": "one", "entries": [{"id": "x"}]})
    stored = documents.stage(documents.scan_json(spark, [str(tmp_path / "in")]), str(tmp_path / "wide"))
    first = documents.first_documents(stored).select("id", "name")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan and [tuple(r) for r in first.collect()] == [("1", "one")]


def test_staging_leaves_no_shuffle_files(spark, tmp_path):
    from periodica.session import SHUFFLES_GO

    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(f) for f in jvm.localDirsString()]

    def files():
        return {f for folder in folders for f in folder.glob("*/shuffle_*")}

    before, setting = files(), spark.conf.get(SHUFFLES_GO, None)
    counted = spark.range(5000).repartition(3).groupBy((F.col("id") % 700).alias("k")).count()
    kept = documents.stage(counted, str(tmp_path / "counted"))
    assert not files() - before
    assert kept.count() == counted.count() == 700
    assert spark.conf.get(SHUFFLES_GO, None) == setting


def test_texts_of_two_folders_are_packed(spark):
    """The folders hold every text, in a third of its characters at most, and not the staged copy."""
    from periodica.plans import driver_views, queries
    from periodica.session import work_dir

    tables = driver_views.Tables(spark, "/root/testdata/sf0.001")
    base = Path(work_dir(spark, "x")).parent
    before = set(base.glob("texts-*"))
    one, two = queries._two_roots(spark, tables)
    assert set(base.glob("texts-*")) == before
    whole = driver_views.document_texts(tables).where(F.col("text").endswith("}"))
    n, chars = whole.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    assert spark.read.text(two, recursiveFileLookup=True).count() == n
    even = whole.where(F.col("id").cast("bigint") % 2 == 0).count()
    assert spark.read.text(one, recursiveFileLookup=True).count() == 2 * even
    assert 3 * sum(f.stat().st_size for f in Path(two).rglob("part-*")) < chars
