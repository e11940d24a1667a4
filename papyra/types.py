"""Declared types as Spark types, and types inferred from documents."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import types as T

#: Declared names and the Spark types behind them.
NAMES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Number": T.DoubleType(),
    "Integer": T.LongType(),
    "Boolean": T.BooleanType(),
    "Date": T.TimestampType(),
    "Array": T.ArrayType(T.StringType()),
    "Object": T.VariantType(),
    "Mixed": T.VariantType(),
    "Subdocument": T.VariantType(),
    "Embedded": T.VariantType(),
    "ObjectId": T.StringType(),
    "UUID": T.StringType(),
    "Map": T.MapType(T.StringType(), T.StringType()),
    "Buffer": T.BinaryType(),
    "Decimal128": T.DecimalType(34, 18),
    "BigInt": T.DecimalType(38, 0),
}
_PYTHON = {str: "String", int: "Integer", float: "Number", bool: "Boolean", dt.datetime: "Date", dt.date: "Date", list: "Array", dict: "Object", bytes: "Buffer", decimal.Decimal: "Decimal128", uuid.UUID: "UUID"}


def named(kind: Any) -> tuple[str, T.DataType]:
    """(declared name, Spark type) of a name, a Python type or a Spark type."""
    if isinstance(kind, type) and issubclass(kind, T.DataType):
        kind = kind()
    if isinstance(kind, T.DataType):
        return kind.simpleString(), kind
    label = kind if isinstance(kind, str) else _PYTHON.get(kind)
    if label not in NAMES:
        raise TypeError(f"unknown type {kind!r}")
    return label, NAMES[label]


def infer(value: Any) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), infer(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(merge_all(map(infer, value)))
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DecimalType(38, 0)
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, decimal.Decimal):
        return T.DecimalType(34, 18)
    if isinstance(value, (dt.datetime, dt.date)):
        return T.TimestampType()
    return T.BinaryType() if isinstance(value, (bytes, bytearray)) else T.StringType()


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds values of both; kinds that don't mix become text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        have = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            have[f.name] = merge(have[f.name], f.dataType) if f.name in have else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in have.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
            return T.LongType()
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            return T.DecimalType(38, max(a.scale, b.scale))
        return T.DoubleType()
    return T.StringType()


def merge_all(kinds: Iterable[T.DataType]) -> T.DataType:
    out: T.DataType = T.NullType()
    for k in kinds:
        out = merge(out, k)
    return out


def fit(value: Any, kind: T.DataType) -> Any:
    """A Python value in the shape that createDataFrame takes for a type."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(fit(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, Mapping) else None
    if isinstance(kind, T.MapType):
        return {str(k): fit(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.ArrayType):
        return [fit(v, kind.elementType) for v in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value) if isinstance(value, uuid.UUID) else json.dumps(value, default=str, ensure_ascii=False)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.TimestampType):
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value)
        if isinstance(value, (int, float)):
            return dt.datetime.fromtimestamp(value / 1000, dt.timezone.utc)
        return value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
    if isinstance(kind, T.BinaryType):
        return bytearray(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return int(value) if isinstance(kind, T.IntegralType) else value
