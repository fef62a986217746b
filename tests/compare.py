"""Spark results against SQL on the same tables, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def difference(df, sql: str, folder: str) -> str:
    """'' if both give the same columns and rows, and any, else what differs."""
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    con.execute("set timezone='UTC'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return "" if got else "no rows on either side"
    return f"{sum(got.values())} rows, SQL has {sum(want.values())}; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
