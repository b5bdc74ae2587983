"""Compares a Spark result with a DuckDB result: names, types, and values without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return db


def _row(values, order):
    return tuple(values[i] for i in order)


def _key(row):
    return tuple((v is None, "" if v is None else v) for v in row)


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value + 0.0 if isinstance(value, float) else value


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for field in df.schema.fields:
        if TYPES.get(field.dataType.simpleString()) != kinds[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}")
    columns = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    theirs = [tuple(_plain(v) for v in _row(r, [names.index(c) for c in columns])) for r in theirs]
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} against {len(theirs)}")
    differing = [(a, b) for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key)) if a != b]
    if differing:
        found.append(f"{len(differing)} rows differ in {columns}, first {differing[0]}")
    return found
