"""What the plans must not contain, whatever the data."""

import re

import pytest

import __spark_entry__ as entry
from periodica.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that a query writes on its way, before it is read back."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen = []
    for name in ("parquet", "text"):
        write = getattr(DataFrameWriter, name)

        def noted(self, *args, _write=write, **kwargs):
            seen.append(plan(self._df))
            return _write(self, *args, **kwargs)

        monkeypatch.setattr(DataFrameWriter, name, noted)
    return seen


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_no_python_no_global_window(spark, name, plans):
    plans.append(plan(entry.queries()[name](spark, FOLDER)))
    text = "\n".join(plans)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF",
                "FlatMapGroups", "MapInPandas", "MapInArrow"):
        assert bad not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert "SinglePartition" not in "".join(lines[i : i + 3])


@pytest.mark.parametrize("name", ["table_page", "table_page_full"])
def test_a_page_derives_its_table_once(spark, name, plans):
    plans.append(plan(entry.queries()[name](spark, FOLDER)))
    assert sum("lineitem.parquet" in p for p in plans) == 1
    assert "lineitem.parquet" not in plans[-1]


def test_only_referenced_entries_are_grouped(spark):
    text = plan(entry.queries()["resolve_refs_prefix"](spark, FOLDER))
    lines = text.splitlines()
    targets = next(i for i, x in enumerate(lines) if "Aggregate" in x and "_across" in x)
    assert any("LeftSemi" in x for x in lines[targets:])


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["direction_balance"](spark, FOLDER))
    schemas = dict(re.findall(r"/(\w+)\.parquet\].*?ReadSchema: struct<([^>]*)>", text))
    assert "l_extendedprice" not in schemas["lineitem"]
    assert set(re.findall(r"(\w+):", schemas["orders"])) == {"o_orderkey", "o_custkey"}


def test_date_filter_reaches_the_scan(spark, tmp_path, puzzles_of):
    from pyspark.sql import functions as F

    from periodica.sources import sinks

    p = puzzles_of([(str(i), "a", f"20{i:02d}-01-01", "x") for i in range(10, 20)])
    full = p.withColumns({"name": F.lit("n"), "creator_weburl": F.lit("u")})
    sinks.write_puzzles(full, str(tmp_path / "p"))
    text = plan(sinks.read_puzzles(spark, str(tmp_path / "p")).where("year = 2012"))
    assert "PartitionFilters: [isnotnull(year" in text
    assert sinks.read_puzzles(spark, str(tmp_path / "p")).where("year = 2012").count() == 1
