"""Side-by-side run of a query and its SQL on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(folder, name)}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value) if value is not None else ""


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    cursor = connection.execute(sql)
    want_columns, want = _table([d[0] for d in cursor.description], cursor.fetchall())
    have_columns, have = _table(frame.columns, [tuple(row) for row in frame.collect()])
    if have_columns != want_columns:
        return f"columns {have_columns} instead of {want_columns}"
    if len(have) != len(want):
        return f"{len(have)} rows instead of {len(want)}: {[x for x in have if x not in set(want)][:2]} / {[x for x in want if x not in set(have)][:2]}"
    for one, other in zip(have, want):
        if one != other:
            return f"{one} instead of {other}"
    return None
