"""Runs a query on Spark and its SQL on DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(map(_value, x))
    return round(float(x), 9) if type(x).__name__ == "Decimal" else x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, f, sql: str) -> str:
    """Empty if both agree, else what differs."""
    got, want = f(spark, sf_dir), connect(sf_dir).execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    if a == b:
        return ""
    only = lambda x, y: [r for r in x if r not in set(y)][:3]
    return f"{len(a)} against {len(b)} rows; only here {only(a, b)}; only there {only(b, a)}"
