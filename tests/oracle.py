"""Compare a query with DuckDB SQL over the same tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows_of(frame) -> tuple[list[str], list[str]]:
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and abs(v) < 1e15 and v == int(v) else v
    return columns, sorted(str(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


def assert_equal(spark, con, sf_dir: str, query, sql: str) -> None:
    mine, theirs = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
