"""Run queries beside their SQL oracles and compare whole results."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_result(df):
    return (*_rows(df.columns, df.collect()), {f.name: f.dataType.simpleString() for f in df.schema})


def oracle_result(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    return (*_rows(names, cur.fetchall()), types)


SAME_TYPE = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def differences(got, want):
    """Readable differences; empty when names, types and all rows agree."""
    out = []
    if got[0] != want[0]:
        out.append(f"columns {got[0]} != {want[0]}")
    for name, kind in got[2].items():
        if name in want[2] and SAME_TYPE.get(kind, kind) != want[2][name]:
            out.append(f"type of {name}: {kind} != {want[2][name]}")
    if len(got[1]) != len(want[1]):
        out.append(f"{len(got[1])} rows != {len(want[1])}")
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        out.append(f"only ours: {sorted(a - b)[:2]}\n   only theirs: {sorted(b - a)[:2]}")
    return out


def main() -> None:
    from periodica.session import local_session
    import __spark_entry__ as entry

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            got = spark_result(queries[name](spark, folder))
            mid = time.time()
            want = oracle_result(con, oracles[name])
            diff = differences(got, want)
            note = f"{len(got[1])} rows spark {mid - start:.2f}s sql {time.time() - mid:.2f}s"
        except Exception as e:
            diff, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        bad += bool(diff)
        print("FAIL" if diff else "ok  ", name, note, flush=True)
        for d in diff:
            print("  ", d[:2500], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
