"""Compares a registered query with its SQL in DuckDB."""

import math
import os
from collections import Counter


def connect(folder):
    import duckdb

    db = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{where}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return float(value) if hasattr(value, "is_finite") else value


def assert_same(df, db, sql):
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs
