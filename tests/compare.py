"""Runs a registered query and its SQL twin and compares the rows."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_session(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql):
    """(equal, message) of a DataFrame and a DuckDB statement."""
    got = sorted_rows(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted_rows(columns, cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return True, f"{len(got[1])} rows"
    extra = [row for row in got[1] if row not in set(want[1])][:2]
    missing = [row for row in want[1] if row not in set(got[1])][:2]
    return False, f"{len(got[1])} rows != {len(want[1])}; only here {extra}; only there {missing}"
