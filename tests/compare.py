"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((c is not None, str(type(c)), c if c is not None else 0) for c in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def differences(expected, actual, limit: int = 3) -> list[str]:
    notes = []
    if expected[0] != actual[0]:
        return [f"columns {expected[0]} != {actual[0]}"]
    if len(expected[1]) != len(actual[1]):
        notes.append(f"rows {len(expected[1])} != {len(actual[1])}")
    for a, b in zip(expected[1], actual[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            notes.append(f"sql {a} spark {b}")
            if len(notes) >= limit:
                break
    return notes
