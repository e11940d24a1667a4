"""Dotted paths and literals as Columns."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scope:
    """What expressions are compiled against: a DataFrame, used for its schema alone."""

    def __init__(self, df: DataFrame, text_fields: list[str] | None = None):
        self.df = df
        self.schema = df.schema
        self.text_fields = text_fields

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("x")).schema["x"].dataType

    def path(self, path: str) -> Column:
        return resolve(path, self.schema)[0]

    def typed(self, path: str) -> tuple[Column, T.DataType]:
        return resolve(path, self.schema)


def name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def resolve(path: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    """Column and type of a dotted path; NULL where nothing has that name.

    A top-level column may contain dots itself and then wins. Paths go through structs, maps, variants and, at any
    depth, arrays of structs (giving an array, flattened).
    """
    if path in schema.names:
        return name(path), schema[path].dataType
    first, *rest = path.split(".")
    if first not in schema.names:
        return F.lit(None), T.NullType()
    return _walk(name(first), schema[first].dataType, rest)


def _walk(column: Column, kind: T.DataType, rest: list[str]) -> tuple[Column, T.DataType]:
    if not rest:
        return column, kind
    key, more = rest[0], rest[1:]
    if isinstance(kind, T.StructType):
        return _walk(column.getField(key), kind[key].dataType, more) if key in kind.names else (F.lit(None), T.NullType())
    if isinstance(kind, T.MapType):
        return _walk(F.try_element_at(column, F.lit(key)), kind.valueType, more)
    if isinstance(kind, T.ArrayType):
        if key.isdigit():
            return _walk(F.get(column, int(key)), kind.elementType, more)
        inner: list[T.DataType] = []

        def step(x: Column) -> Column:
            c, t = _walk(x, kind.elementType, rest)
            inner.append(t)
            return c

        found = F.transform(column, step)
        if isinstance(inner[0], T.NullType):
            return F.lit(None), T.NullType()
        return (F.flatten(found), inner[0]) if isinstance(inner[0], T.ArrayType) else (found, T.ArrayType(inner[0]))
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, "$." + ".".join(rest), "variant"), T.VariantType()
    return F.lit(None), T.NullType()


def literal(value: Any) -> Column:
    """A Python value as a Column: lists as arrays, dicts as structs."""
    if isinstance(value, Column):
        return value
    if isinstance(value, Mapping):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return F.array(*(literal(v) for v in value))
    return F.lit(value)


def kind_of(x: Any) -> str:
    """'number', 'string', 'boolean', 'date', 'array', 'object', 'null' or 'variant', of a data type or a value."""
    if isinstance(x, T.DataType):
        for name_, kinds in (("number", T.NumericType), ("string", T.StringType), ("boolean", T.BooleanType), ("date", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("array", T.ArrayType), ("object", (T.StructType, T.MapType)), ("null", T.NullType), ("variant", T.VariantType)):
            if isinstance(x, kinds):
                return name_
        return "binary"
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(x, (dt.date, dt.datetime)):
        return "date"
    if isinstance(x, Mapping):
        return "object"
    return {str: "string", list: "array", tuple: "array", bytes: "binary", re.Pattern: "pattern"}.get(type(x), "other")


def alike(kind: T.DataType, value: Any) -> bool:
    """Whether values of a type can be compared with value at all; of different kinds they never match."""
    a, b = kind_of(kind), kind_of(value)
    return a == b or "variant" in (a, b) or {a, b} == {"date", "string"} or b == "other"
