"""DuckDB over the driver's tables, and comparison of rows without regard to order."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for file in os.listdir(folder):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    expected = c.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, expected.fetchall())
