"""Compare a query with its SQL over one folder of tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


def table_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def both(spark, name, query, sql, folder: Path):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    df = query(spark, str(folder))
    ours = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), name
    return ours, table_of(names, cur.fetchall())
