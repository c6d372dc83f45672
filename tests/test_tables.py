"""Search, sort and page."""

import pytest

from periodica.operators import tables

COLUMNS = "name string, text string, day string"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"n{i % 7}", f"Text {i:02d}" if i % 9 else None, f"2020-01-{i % 28 + 1:02d}") for i in range(60)]
    rows += [("100%", "back\\slash", "x"), ("under_score", "ÄRGER", "y")]
    return spark.createDataFrame(rows, COLUMNS)


def found(table, search, literal=False, columns=("name", "text")):
    return {r.name for r in tables.table_search(table, search, columns, literal).collect()}


def test_search_ignores_case_and_columns_that_are_not_searchable(table):
    assert tables.table_search(table, "tExT 1", ["name", "text"]).count() == 9
    assert found(table, "2020-01") == set()
    assert found(table, "ärg") == {"under_score"}
    assert tables.table_search(table, "", ["name"]).count() == 62


def test_wildcards_and_backslash(table):
    assert found(table, "1%%") == {"100%"} | {r.name for r in table.where("text like '%1%'").collect()}
    assert found(table, "0%", literal=True) == {"100%"}
    assert found(table, "r_s", literal=True) == {"under_score"}
    assert found(table, "back\\slash") == {"100%"}
    assert found(table, "\\", literal=True) == {"100%"}
    assert found(table, "'") == set()


def test_column_search_is_a_conjunction(table):
    got = tables.column_search(table, {"name": "N1", "text": "text 2", "day": ""})
    assert sorted(r.text for r in got.collect()) == ["Text 22", "Text 29"]


@pytest.mark.parametrize("column, direction", [(None, "asc"), (0, "DESC"), (1, "desc"), (2, "up"), (9, "desc"), (-1, "asc")])
def test_pages_make_up_the_sorted_table(table, column, direction):
    whole = [tuple(r) for r in tables.table_sort(table, column, direction).collect()]
    key = lambda row, i: (row[i] is None, row[i] or "")
    want = sorted(map(tuple, table.collect()), key=lambda r: [key(r, i) for i in range(3)])
    if column in (0, 1, 2):
        filled = [r for r in want if r[column] is not None]
        filled.sort(key=lambda r: r[column], reverse=direction.lower() == "desc")
        want = filled + [r for r in want if r[column] is None]
    assert whole == want
    pages = []
    for start in range(0, 70, 20):
        pages += [tuple(r) for r in tables.table_page(table, column, direction, start, 20).collect()]
    assert pages == whole


@pytest.mark.parametrize("column, direction", [(None, "asc"), (0, "desc"), (1, "desc"), (1, "asc")])
def test_walking_with_the_last_row_makes_up_the_sorted_table(table, column, direction):
    whole = [tuple(r) for r in tables.table_sort(table, column, direction).collect()]
    walked = tables.table_page(table, column, direction, 0, 13).collect()
    while len(walked) < len(whole):
        more = tables.page_after(table, walked[-1].asDict(), column, direction, 13).collect()
        assert more
        walked += more
    assert [tuple(r) for r in walked] == whole


SPEC = tables.NamedTable(None, keys=("name", "text", "day"), searchable=("name", "text"))


def test_result_page(table):
    page = tables.result_page(SPEC, table, draw=4, search="n1", column=1, length=0)
    assert (page.draw, page.records_total, page.records_filtered) == (4, 62, 9)
    data = page.data.collect()
    # The one row without a text is counted, but not shown.
    assert len(data) == 8 and all(r.text for r in data)
    assert tables.result_page(SPEC, table, search="no such").data.count() == 0
    assert tables.result_page(SPEC, table, start=1000).data.count() == 0
    assert tables.result_page(SPEC, table, length=-1).data.count() <= 10
    with pytest.raises(ValueError):
        tables.result_page(SPEC, table, start=-1)


def test_unknown_table(puzzles_of):
    with pytest.raises(ValueError, match="unknown table"):
        tables.table_request("nothing", None, puzzles_of([("1", "a", "2020-01-01", "x")]), "unused")


def test_table_total_derives_its_views_once(spark):
    from periodica.plans.queries import QUERIES

    read = QUERIES["table_total"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("lineitem" in f or "orders" in f for f in read)
