"""Comparing a query's rows with DuckDB's."""

from __future__ import annotations

import os

import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if not os.path.exists(f"{sf_dir}/{t}.parquet"):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return v


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def rows_of_sql(con, sql: str, columns: list[str]) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
