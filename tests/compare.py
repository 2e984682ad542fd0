"""Runs a registered query and its SQL twin and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{Path(sf_dir) / name}.parquet')")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (2, "nan" if math.isnan(number) else f"{round(number, 6) + 0.0:.6f}")
    return (3, str(value))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(frame, sql: str, sf_dir: str) -> str | None:
    """None if equal, else a short description."""
    names, rows = normal(frame.columns, [tuple(r) for r in frame.collect()])
    wanted_names, wanted = normal(*oracle_rows(sql, sf_dir))
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows, oracle {len(wanted)}"
    for ours, theirs in zip(rows, wanted):
        if ours != theirs:
            return f"{ours} != {theirs}"
    return None
