"""Filter documents as boolean Columns.

NULL means missing: comparisons with it are false, $ne, $nin and $exists: false are true. In AND and OR contexts leaves
stay bare, so that they reach the Parquet reader; under $nor and $not they are made two-valued first.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.expressions import compile_expr, truthy
from papyra.functions.geo import compile_within, metres_between
from papyra.functions.paths import Scope, _walk, alike, kind_of, literal

_FLAGS = {re.I: "i", re.M: "m", re.S: "s"}


def compile_filter(spec: Mapping[str, Any], scope: Scope) -> Column:
    terms = []
    for key, value in (spec or {}).items():
        if key in ("$and", "$or", "$nor"):
            parts = [compile_filter(x, scope) for x in value]
            if key == "$and":
                terms.append(_all(parts))
            elif key == "$or":
                terms.append(reduce(lambda a, b: a | b, parts) if parts else F.lit(False))
            else:
                terms.append(_all([~_sure(x) for x in parts]))
        elif key == "$not":
            terms.append(~_sure(compile_filter(value, scope)))
        elif key == "$expr":
            terms.append(truthy(compile_expr(value, scope), scope))
        elif key == "$where":
            if not isinstance(value, str):
                raise TypeError("$where takes a Spark SQL condition")
            terms.append(F.expr(value))
        elif key == "$text":
            terms.append(text_search(value["$search"] if isinstance(value, Mapping) else value, scope))
        elif key == "$jsonSchema":
            terms.append(compile_json_schema(value, scope))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key}")
        else:
            terms.append(_field(*scope.typed(key), value, scope))
    return _all(terms)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _sure(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def _field(column: Column, kind: T.DataType, value: Any, scope: Scope) -> Column:
    if isinstance(value, Mapping) and any(k.startswith("$") for k in value):
        options = value.get("$options", "")
        rest = {k: v for k, v in value.items() if k not in ("$options", "$maxDistance", "$minDistance")}
        return _all([_operator(column, kind, op, (v, options) if op == "$regex" else (v, value) if op in ("$near", "$nearSphere") else v, scope) for op, v in rest.items()])
    return equals(column, kind, value)


def equals(column: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return column.isNull()
    if isinstance(value, re.Pattern):
        return matches(column, kind, value, "")
    if not alike(kind, value):
        return F.lit(False)
    if isinstance(value, Mapping):
        if not isinstance(kind, T.StructType) or not set(value) <= set(kind.names):
            return F.lit(False)
        return column.isNotNull() & _all([equals(column.getField(f.name), f.dataType, value.get(f.name)) for f in kind.fields])
    if isinstance(value, (list, tuple)) and not value:
        return F.size(column) == 0
    return column == literal(value)


def matches(column: Column, kind: T.DataType, pattern: Any, options: str) -> Column:
    if isinstance(pattern, re.Pattern):
        options += "".join(letter for flag, letter in _FLAGS.items() if pattern.flags & flag)
        pattern = pattern.pattern
    if bad := set(options) - set("imsx"):
        raise ValueError(f"unknown pattern options {sorted(bad)}")
    if kind_of(kind) != "string":
        return F.lit(False)
    return column.rlike((f"(?{''.join(sorted(set(options)))})" if options else "") + pattern)


def _members(column: Column, kind: T.DataType, values: list) -> Column:
    if isinstance(kind, T.ArrayType):
        wanted = [v for v in values if v is not None and alike(kind.elementType, v)]
        return _sure(F.arrays_overlap(column, literal(wanted))) if wanted else F.lit(False)
    wanted = [v for v in values if v is not None and not isinstance(v, (re.Pattern, Mapping, list, tuple)) and alike(kind, v)]
    out = column.isin(*wanted) if wanted else F.lit(False)
    for v in values:
        if v is None or isinstance(v, (re.Pattern, Mapping)):
            out = out | equals(column, kind, v)
    return out


def _operator(column: Column, kind: T.DataType, op: str, value: Any, scope: Scope) -> Column:
    none = F.lit(False)
    if op == "$eq":
        return equals(column, kind, value)
    if op == "$ne":
        if value is None:
            return column.isNotNull()
        if isinstance(value, (Mapping, re.Pattern, list, tuple)) or not alike(kind, value):
            return ~_sure(equals(column, kind, value))
        return (column != literal(value)) | column.isNull()
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if value is None or not alike(kind, value):
            return none
        other = literal(value)
        return {"$gt": column > other, "$gte": column >= other, "$lt": column < other, "$lte": column <= other}[op]
    if op == "$in":
        return _members(column, kind, list(value))
    if op == "$nin":
        if isinstance(kind, T.ArrayType) or any(v is None or isinstance(v, (re.Pattern, Mapping)) for v in value):
            return ~_sure(_members(column, kind, list(value)))
        wanted = [v for v in value if alike(kind, v)]
        return ~column.isin(*wanted) | column.isNull() if wanted else F.lit(True)
    if op == "$regex":
        return matches(column, kind, *value)
    if op == "$exists":
        return column.isNotNull() if value else column.isNull()
    if op == "$type":
        return _typed(column, kind, value)
    if op == "$mod":
        divisor, rest = value
        return F.try_mod(column, F.lit(divisor)) == rest if kind_of(kind) == "number" else none
    if op == "$text":
        return F.lower(column).contains(value.lower()) if kind_of(kind) == "string" else none
    if op == "$all":
        wanted = [v for v in value if isinstance(kind, T.ArrayType) and alike(kind.elementType, v)]
        if not isinstance(kind, T.ArrayType) or len(wanted) < len(value):
            return none
        return F.size(F.array_except(literal(wanted), column)) == 0 if wanted else none
    if op == "$size":
        return F.size(column) == value if isinstance(kind, T.ArrayType) else none
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            return none
        if any(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in value):
            return F.exists(column, lambda x: _sure(_field(x, kind.elementType, value, scope)))
        return F.exists(column, lambda x: _sure(compile_filter(value, _Element(x, kind.elementType))))
    if op == "$not":
        return ~_sure(_field(column, kind, value, scope))
    if op in ("$near", "$nearSphere"):
        point, options = value
        if isinstance(point, Mapping):
            options = {**options, **{k: v for k, v in point.items() if k != "$geometry"}}
            point = point.get("$geometry", point)
            point = point["coordinates"] if isinstance(point, Mapping) else point
        away = metres_between(column, *point)
        out = away.isNotNull()
        if (far := options.get("$maxDistance")) is not None:
            out = away <= far
        return out & (away >= options["$minDistance"]) if options.get("$minDistance") is not None else out
    if op in ("$geoWithin", "$within", "$geoIntersects"):
        return compile_within(column, value, edges=op == "$geoIntersects")
    raise ValueError(f"unknown filter operator {op}")


class _Element(Scope):
    """An array's element as the document of a nested filter."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind
        self.schema = kind if isinstance(kind, T.StructType) else T.StructType()
        self.text_fields = None

    def typed(self, path: str) -> tuple[Column, T.DataType]:
        return _walk(self.column, self.kind, path.split("."))

    def path(self, path: str) -> Column:
        return self.typed(path)[0]


_NAMES = {"double": "number", "int": "number", "long": "number", "decimal": "number", "bool": "boolean", "timestamp": "date"}


def _typed(column: Column, kind: T.DataType, value: Any) -> Column:
    wanted = {_NAMES.get(v, v) for v in ([value] if isinstance(value, str) else value)}
    own = kind_of(kind)
    if own == "variant":
        like = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*", "date": "^(DATE|TIMESTAMP.*)$", "null": "^VOID$"}
        return _sure(reduce(lambda a, b: a | b, (F.schema_of_variant(column).rlike(like[w]) for w in wanted)))
    # Arrays and dates are objects, as typeof has it.
    fits = own in wanted or ("object" in wanted and own in ("array", "date"))
    return column.isNotNull() if fits else F.lit(False)


def text_search(query: str, scope: Scope) -> Column:
    """Case-insensitive substring over the text-indexed fields, or all string fields."""
    fields = scope.text_fields if scope.text_fields is not None else [f.name for f in scope.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = [F.lower(scope.path(f)).contains(query.lower()) for f in fields]
    return reduce(lambda a, b: _sure(a) | _sure(b), parts) if parts else F.lit(False)


def compile_json_schema(spec: Mapping[str, Any], scope: Scope) -> Column:
    """required, and of properties: type (bsonType), enum, minimum, maximum, minLength, maxLength, pattern, properties."""
    terms = [scope.path(k).isNotNull() for k in spec.get("required", ())]
    for key, rule in spec.get("properties", {}).items():
        column, kind = scope.typed(key)
        terms.append(_all([column.isNull() | _sure(t) for t in _rules(column, kind, rule)]))
    return _all(terms)


def _rules(column: Column, kind: T.DataType, rule: Mapping[str, Any]) -> list[Column]:
    out = []
    if wanted := rule.get("type") or rule.get("bsonType"):
        wanted = [wanted] if isinstance(wanted, str) else wanted
        out.append(_typed(column, kind, ["number" if w == "integer" else w for w in wanted]))
        if wanted == ["integer"] and kind_of(kind) == "number":
            out.append(column == F.floor(column))
    if "enum" in rule:
        out.append(_members(column, kind, list(rule["enum"])))
    for key, op in (("minimum", "$gte"), ("maximum", "$lte")):
        if key in rule and alike(kind, rule[key]):
            out.append(column >= rule[key] if op == "$gte" else column <= rule[key])
    if "minLength" in rule:
        out.append(F.length(column) >= rule["minLength"])
    if "maxLength" in rule:
        out.append(F.length(column) <= rule["maxLength"])
    if "pattern" in rule:
        out.append(matches(column, kind, rule["pattern"], ""))
    if isinstance(kind, T.StructType):
        out += [column.getField(k).isNotNull() if k in kind.names else F.lit(False) for k in rule.get("required", ())]
        for k, inner in rule.get("properties", {}).items():
            if k in kind.names:
                out.append(column.getField(k).isNull() | _all([_sure(x) for x in _rules(column.getField(k), kind[k].dataType, inner)]))
    return out
