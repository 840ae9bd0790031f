"""A query's rows against those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def rows(names: list[str], values: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([v[k] for k in order]) for v in values)


def assert_same(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = db.execute(sql)
    names, values = [c[0] for c in found.description], found.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, values)
