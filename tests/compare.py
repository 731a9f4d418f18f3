"""Compare a query with its SQL, as multisets of rows with columns by name."""

import math
import os

import duckdb


def connect(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data_dir):
        path = f"{data_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{data_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def both(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    return got, want
