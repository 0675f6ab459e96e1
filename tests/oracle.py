"""Compares a query with its SQL in DuckDB: columns by name, rows in any order, numbers rounded."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def rows_of_df(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    a, b = rows_of_df(query(spark, sf_dir)), rows_of_sql(sf_dir, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; first {a[1][:2]} and {b[1][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y and not all(u == v or isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6) for u, v in zip(x, y, strict=True))]
    return f"{len(bad)} of {len(a[1])} rows differ; first {str(bad[0])[:600]}" if bad else ""
