"""Pages of tables that are stored in their order."""

import random

import pytest

from periodica.operators.tables import table_page, table_sort
from periodica.sources import page_index


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.randrange(40), rng.choice(["x", "y", None])) for _ in range(700)]
    rows += [("b", 7, "x")] * 90  # rows equal in all columns
    return spark.createDataFrame(rows, "name string, number int, note string").repartition(5)


@pytest.mark.parametrize("column, direction", [(None, "asc"), (0, "DESC"), (1, "desc"), (2, "asc"), (9, "desc")])
def test_pages_are_those_of_the_sorted_table(table, tmp_path, column, direction):
    whole = list(map(tuple, table_sort(table, column, direction).collect()))
    stored = page_index.write_sorted(table, str(tmp_path / "t"), column, direction, ranges=12)
    assert stored.total == len(whole) and len(stored.ranges) > 5
    for start, length in ((0, 10), (395, 33), (780, 30), (0, 0), (250, 300), (790, 5), (5000, 5)):
        got = list(map(tuple, stored.page(start, length).collect()))
        assert got == whole[start : start + (length or 10)], (start, length)
    again = page_index.read_sorted(table.sparkSession, str(tmp_path / "t"))
    assert again == stored
    with pytest.raises(ValueError):
        stored.page(-1)


def test_a_page_reads_its_own_ranges(table, tmp_path):
    stored = page_index.write_sorted(table, str(tmp_path / "t"), 1, "asc", ranges=12)
    middle = stored.ranges[len(stored.ranges) // 2]
    page = stored.page(middle[1] + 1, 3)
    assert [tuple(r) for r in page.collect()] == [tuple(r) for r in table_page(table, 1, "asc", middle[1] + 1, 3).collect()]
    plan = page._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "_range" in filters and str(middle[0]) in filters
    assert "Exchange rangepartitioning" not in plan and "TakeOrderedAndProject" in plan


def test_a_table_without_rows(table, tmp_path):
    stored = page_index.write_sorted(table.limit(0), str(tmp_path / "t"), 0)
    assert stored.page(0, 5).columns == table.columns and stored.page(0, 5).count() == 0
    assert stored.total == 0 and page_index.read_sorted(table.sparkSession, str(tmp_path / "t")).ranges == ()


def test_written_again(table, tmp_path):
    page_index.write_sorted(table, str(tmp_path / "t"), 0, ranges=9)
    stored = page_index.write_sorted(table.where("number < 3"), str(tmp_path / "t"), 1, "desc", ranges=2)
    assert stored.total == table.where("number < 3").count() and (stored.column, stored.direction) == (1, "desc")
