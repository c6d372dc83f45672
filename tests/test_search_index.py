"""Searches through an index of trigrams find what they find without it, and read less."""

import random

import pytest

from periodica.operators.tables import TABLES, search_condition, table_counts, table_groups
from periodica.sources import search_index

ANSWERS = TABLES["dup_answers"]
USES = (
    "creator_name string, solution string, number int, crossword_id string, clue string,"
    " crossword_type string, link string, n_uses long"
)
SEARCHES = ["word7", "WORD7 ", "w%7", "d1_w", "ord", "rd", "%", "__", "100%", "a_b", "ΟΔΟΣ", "straße", "🙂🙃x", "no such", "x\x01y", "é\nb", "dot.", "back\\slash"]


@pytest.fixture(scope="module")
def uses(spark):
    rng = random.Random(11)
    extra = ["100%", "a_b", "axb", "ΟΔΟΣ ΟΔΟΣΑ", "οδος", "STRASSE straße", "🙂🙃xy", "x\x01y", "É\nB", "dot.", "dotx", "back\\slash", "", None]
    rows = []
    for i in range(900):
        clue = " ".join(f"word{rng.randrange(300)}" for _ in range(4)) if i % 6 else rng.choice(extra)
        setter = rng.choice(["Ann", "Ann", "Ann", "Bob", "Çelik", None])
        rows.append((setter, f"sol{rng.randrange(200):03d}" if i % 50 else None, i % 70, str(i), clue, "prize", f"l{i}", 1))
    rows += [("Ann", "sol000", 1, "1", "word1 again", "prize", "l", 1)] * 80
    return spark.createDataFrame(rows, USES).repartition(4)


@pytest.fixture(scope="module")
def index(uses, tmp_path_factory):
    return search_index.write_search_index(ANSWERS, uses, str(tmp_path_factory.mktemp("index")), parts=24)


def found(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("literal", [False, True])
def test_the_same_groups_as_without_an_index(uses, index, literal):
    for search in SEARCHES:
        test = search_condition(search, ANSWERS.searchable, literal)
        assert found(index.search(search, literal)) == found(table_groups(ANSWERS, uses, [test])), search
    assert found(index.search("")) == found(table_groups(ANSWERS, uses))
    count = table_counts(ANSWERS, uses, "word7", literal).first()["records_filtered"]
    assert index.filtered("word7", literal).first()[0] == count > 0


def test_columns_by_themselves(uses, index):
    for searches in ({"creator_name": "ann", "clue": "word1"}, {"solution": "sol01", "clue": ""}, {"clue": "wo", "creator_name": "çel"}):
        tests = [search_condition(s, [c]) for c, s in searches.items() if s]
        assert found(index.column_search(searches)) == found(table_groups(ANSWERS, uses, tests))
    with pytest.raises(ValueError):
        index.column_search({"number": "1"})


def test_only_parts_with_all_grams_are_read(uses, index):
    assert index.rows().count() == uses.count()
    every = index.rows().select("_metadata.file_path").distinct().count()
    parts = index.parts([("sol123", ANSWERS.searchable)])
    assert 0 < len(parts) <= 6 and index.parts([("so", ANSWERS.searchable)]) is None
    assert index.parts([("zqzq", ANSWERS.searchable)]) == [] and index.search("zqzq").count() == 0
    df = index.search("sol123")
    assert 0 < len(df.inputFiles()) and index.rows(parts).select("_metadata.file_path").distinct().count() < every / 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_part" in filters


def test_groups_are_whole_and_may_be_a_single_use(uses, index, spark, tmp_path):
    stored = spark.read.parquet(f"{index.path}/rows")
    assert stored.groupBy(*ANSWERS.keys).agg({"_part": "min"}).count() == stored.select(*ANSWERS.keys, "_part").distinct().count()
    empty = search_index.write_search_index(ANSWERS, uses.limit(0), str(tmp_path / "e"), parts=3)
    assert empty.search("word7").count() == 0 and empty.search("").count() == 0
    links = spark.createDataFrame([("Ann", "http://x/1.pdf", "2001-01-02"), ("Bob", None, None)], "creator_name string, link string, date_text string")
    other = search_index.write_search_index(TABLES["doc_links"], links, str(tmp_path / "l"), parts=3)
    assert [r["creator_name"] for r in other.search("1.PDF").collect()] == ["Ann"]


def test_groups_are_stored_once_for_all_searches(uses, index):
    assert found(index.groups()) == found(table_groups(ANSWERS, uses))
    # A search sorts no uses: what a group has is read from the stored groups.
    plan = index.search("word7")._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "SortAggregate" not in plan
