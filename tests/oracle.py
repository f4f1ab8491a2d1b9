"""Comparing a query with its DuckDB equivalent: same columns, same rows in any order."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, table):
    return sorted(tuple(str(v) for v in row) for row in ((r[c] for c in columns) for r in table))


def assert_equal(found, con, sql):
    expected = con.sql(sql).to_arrow_table().to_pylist()
    columns = sorted(found.columns)
    names = sorted(x[0] for x in con.execute(f"DESCRIBE {sql}").fetchall())
    assert columns == names
    assert rows(columns, [r.asDict() for r in found.collect()]) == rows(columns, expected)
