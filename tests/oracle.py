"""Runs a query's SQL beside it and compares all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return None if math.isnan(float(value)) else round(float(value), 4)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def differences(spark, name, query, sql, sf_dir: str = SMALL) -> str:
    """Empty if the rows agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = connection(sf_dir).execute(sql)
    want = rows([d[0] for d in relation.description], relation.fetchall())
    if got[0] != want[0]:
        return f"{name}: columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{name}: {len(got[1])} and {len(want[1])} rows; {got[1][:2]} {want[1][:2]}"
    off = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{name}: {len(off)} of {len(got[1])} rows differ, as {off[0]}" if off else ""
