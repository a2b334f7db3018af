"""Compares a query with its SQL on the driver's tables."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=str)


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want), (len(got), len(want))
    assert got == want
