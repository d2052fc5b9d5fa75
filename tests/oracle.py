"""Compare a Spark result with DuckDB's, as sets of rows with columns by name."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, connection, sql):
    got = df.toArrow()
    want = connection.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.column_names) == sorted(names)
    a = rows(got.column_names, list(zip(*[c.to_pylist() for c in got.columns])) if got.num_columns else [])
    b = rows(names, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
