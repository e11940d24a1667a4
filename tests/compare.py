"""Runs a query and its oracle SQL over the same tables and compares their rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, sf_dir: str, sql: str) -> str:
    """What differs, or the empty text."""
    columns, rows = canonical(df.columns, df.collect())
    wanted_columns, wanted = canonical(*oracle(sf_dir, sql))
    if columns != wanted_columns:
        return f"columns {columns}; the oracle has {wanted_columns}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows; the oracle has {len(wanted)}"
    return next((f"{a} is {b} in the oracle" for a, b in zip(rows, wanted, strict=True) if a != b), "")
