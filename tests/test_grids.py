"""Fingerprints, catalogue and matching."""

import random

import pytest
from pyspark.sql import functions as F

from periodica.operators import grids
from periodica.sources.grids import grid_scan
from periodica.sources.pages import accessible_fingerprint


def random_grid(rng, rows=15, cols=15):
    return [[int(rng.random() < 0.7) for _ in range(cols)] for _ in range(rows)]


def runs(grid):
    """Entries covering every white cell: (direction, length, x, y)."""
    out = []
    for y, row in enumerate(grid):
        x = 0
        while x < len(row):
            n = 0
            while x + n < len(row) and row[x + n]:
                n += 1
            if n:
                out.append(("across", n, x, y))
            x += max(n, 1)
    out.append(next((("down", 1, x, y) for _, _, x, y in out), None))
    return [r for r in out if r]


def fingerprint(grid):
    cols = len(grid[0])
    return ",".join(str(y * cols + x) for y, r in enumerate(grid) for x, w in enumerate(r) if w)


ENTRY = "crossword_id string, direction string, length int, pos_x int, pos_y int"


@pytest.fixture(scope="module")
def layouts():
    rng = random.Random(9)
    return {f"M{i:02d}": random_grid(rng) for i in range(8)}


def write(folder, layouts, mark="{}"):
    folder.mkdir()
    for name, grid in layouts.items():
        text = "\n".join(",".join(mark.format(c) for c in r) for r in grid)
        (folder / f"{name}.grid").write_text(text + "\n")


def test_scan(spark, tmp_path, layouts):
    write(tmp_path / "g", layouts)
    got = {r.grid_name: r for r in grid_scan(spark, str(tmp_path / "g"))[0].collect()}
    assert set(got) == set(layouts)
    for name, grid in layouts.items():
        assert (got[name].n_rows, got[name].n_cols) == (15, 15)
        assert got[name].fingerprint == fingerprint(grid)


def test_files_that_are_no_grids(spark, tmp_path, layouts):
    write(tmp_path / "g", layouts)
    for name, text in {"README": "hello", "short.grid": "1,0\n1", "words.grid": "a,b", "none.grid": " \n"}.items():
        (tmp_path / "g" / name).write_text(text)
    good, bad = grid_scan(spark, str(tmp_path / "g"))
    assert {r.grid_name for r in good.collect()} == set(layouts)
    assert {r.grid_name: r.reason for r in bad.collect()} == {
        "short": "lines of different lengths", "words": "not a number", "none": "no lines",
    }


def test_numbers_may_be_written_as_decimals(spark, tmp_path, layouts):
    write(tmp_path / "g", {"A.1": layouts["M01"]}, "{}.0")
    row = grid_scan(spark, str(tmp_path / "g"))[0].first()
    assert (row.grid_name, row.fingerprint) == ("A.1", fingerprint(layouts["M01"]))


def test_match(spark, tmp_path, layouts):
    layouts = dict(layouts, M99=layouts["M03"])
    write(tmp_path / "g", layouts)
    catalogue, _ = grid_scan(spark, str(tmp_path / "g"))
    rng = random.Random(4)
    shown = {f"p{i}": layouts[f"M{i:02d}"] for i in range(8)}
    shown["new"] = random_grid(rng)
    shown["wide"] = random_grid(rng, 21, 21)
    rows = [(p, *r) for p, g in shown.items() for r in runs(g)]
    rows += rows[:50]
    prints = grids.grid_fingerprint(spark.createDataFrame(rows, ENTRY))
    got = {r.crossword_id: r for r in grids.grid_match(prints, catalogue).collect()}
    assert got["wide"].fingerprint is None and got["wide"].grid_name is None
    assert got["new"].grid_name is None and got["new"].n_names == 0
    for i in range(8):
        assert got[f"p{i}"].grid_name == f"M{i:02d}"
        assert got[f"p{i}"].n_names == (2 if i == 3 else 1)
    names = dict(map(tuple, grids.catalogue_names(catalogue).collect()))
    assert names["M99"] == names["M03"] == "M03"

    usage = [tuple(r) for r in grids.grid_usage(grids.grid_match(prints, catalogue)).collect()]
    assert usage[0] == (None, 2) and len(usage) == 9
    docs = spark.createDataFrame([("p1", "old"), ("new", "old"), ("none", None)], "id string, _gridType string")
    noted = grids.grid_annotate(docs, grids.grid_match(prints, catalogue))
    assert {r.id: r._gridType for r in noted.collect()} == {"p1": "M01", "new": None, "none": None}


def test_dimensions_are_part_of_the_key(spark):
    df = spark.createDataFrame([("a", "across", 2, 0, 0, 2, 2), ("b", "across", 2, 0, 0, 1, 4)],
                               ENTRY + ", r int, c int")
    prints = grids.grid_fingerprint(df, n_rows="r", n_cols="c")
    catalogue = spark.createDataFrame([("G", 2, 2, "0,1")], "grid_name string, n_rows int, n_cols int, fingerprint string")
    assert {r.crossword_id: r.grid_name for r in grids.grid_match(prints, catalogue).collect()} == {
        "a": "G", "b": None,
    }


def test_blank_letters_of_an_accessible_page(spark, layouts):
    def page(grid, spoil=""):
        rows = "".join(
            f'<li class="x row-data" id="{y}">Row {y}: '
            + " ".join((chr if y % 2 else lambda n: chr(n).lower())(65 + x) for x, w in enumerate(r) if not w)
            + "</li>\n"
            for y, r in enumerate(grid)
        )
        return f"<ul><li>no data: A B</li>{rows}{spoil}</ul>"

    late = '<li class="row-data">nothing here</li><li class="row-data">Row 16: A</li>'
    pages = [
        (name, page(g), fingerprint(g)) for name, g in layouts.items()
    ] + [
        ("stops", page(layouts["M01"], late), fingerprint(layouts["M01"])),
        ("too many rows", page(layouts["M01"], '<li class="row-data">Row 16: A</li>'), None),
        ("too far", page(layouts["M01"][:14], '<li class="row-data">Row 15: P</li>'), None),
        ("none", "<ul></ul>", ",".join(map(str, range(225)))),
    ]
    df = spark.createDataFrame(pages, "name string, html string, want string")
    got = df.select("name", "want", accessible_fingerprint(F.col("html"), "row-data").alias("got"))
    assert [r.name for r in got.collect() if r.got != r.want] == []


def test_grid_scan_reads_every_shared_layout(spark, tmp_path):
    """Four puzzles share a layout that far less than one puzzle in 500 has."""
    from periodica.plans.queries import QUERIES

    lines = [(k, n) for k in range(3000) for n in ((1, 2) if k < 4 else (1,) if k < 7 else (3,))]
    tables = {
        "lineitem": spark.createDataFrame(
            [(k, n, "F", 1) for k, n in lines],
            "l_orderkey long, l_linenumber int, l_linestatus string, l_partkey long",
        ),
        "part": spark.createDataFrame([(1, "blue ring", 5)], "p_partkey long, p_name string, p_size int"),
        "nation": spark.createDataFrame([(1, "NATION_1")], "n_nationkey int, n_name string"),
    }
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = QUERIES["grid_scan"](spark, str(tmp_path)).where("reason is null").collect()
    # The one of three puzzles has no file; that of most puzzles has two.
    assert sorted(r.fingerprint for r in found) == ["0,1,2", "2,3", "2,3"]
