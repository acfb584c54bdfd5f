"""Compare a DataFrame with what DuckDB gives for its SQL, as unordered rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    if isinstance(x, bool):
        return x
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str):
    """(columns of both, rows only here, rows only there)."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    return (sorted(df.columns), sorted(names)), list((mine - theirs).items())[:3], list((theirs - mine).items())[:3], sum(mine.values())
