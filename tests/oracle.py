"""Compares a query with its SQL in DuckDB, whatever the order of rows."""

import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(found):
    return sorted(tuple(_plain(r[c]) for c in sorted(r)) for r in found)


def in_duckdb(sql, sf, tables=None):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    for name, table in (tables or {}).items():
        con.execute(f"drop view if exists {name}")
        con.register(name, table)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, [dict(zip(names, r, strict=True)) for r in out.fetchall()]


def assert_same(df, sql, sf, tables=None):
    names, want = in_duckdb(sql, sf, tables)
    assert sorted(df.columns) == sorted(names)
    assert rows([r.asDict() for r in df.collect()]) == rows(want)
