"""Runs a query and its SQL over the same tables and compares all values."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(data: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(data, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def values(rows: list, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows)


def agree(spark, query, sql: str, data: str = DATA) -> None:
    df = query(spark, data)
    result = connect(data).execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert values([tuple(r) for r in df.collect()], df.columns) == values(result.fetchall(), columns)
