"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows(df) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple[str, ...]]]:
    done = connection(sf_dir).execute(sql)
    names = [d[0] for d in done.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in at) for r in done.fetchall())
