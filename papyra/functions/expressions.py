"""Expression documents as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paths import Scope, kind_of, literal


def compile_expr(spec: Any, scope: Scope) -> Column:
    """"$path", {"$operator": arguments}, {"field": expression, ...} (a struct), or a literal."""
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str) and spec.startswith("$$ROOT"):
        return scope.path(spec[7:]) if spec[6:7] == "." else F.struct(*(F.col(f"`{c}`") for c in scope.schema.names))
    if isinstance(spec, str) and spec.startswith("$"):
        return scope.path(spec[1:])
    if isinstance(spec, Mapping):
        operators = [k for k in spec if k.startswith("$")]
        if not operators:
            return F.struct(*(compile_expr(v, scope).alias(k) for k, v in spec.items())) if spec else F.struct()
        if len(spec) != 1:
            raise ValueError(f"an expression has one operator: {sorted(spec)}")
        if operators[0] not in OPERATORS:
            raise ValueError(f"unknown expression operator {operators[0]}")
        return OPERATORS[operators[0]](spec[operators[0]], scope)
    if isinstance(spec, (list, tuple)):
        return F.array(*(compile_expr(x, scope) for x in spec))
    return literal(spec)


def _args(spec: Any, scope: Scope) -> list[Column]:
    return [compile_expr(x, scope) for x in (spec if isinstance(spec, (list, tuple)) else [spec])]


def truthy(column: Column, scope: Scope) -> Column:
    """Boolean of a value: null, false, 0, NaN and the empty string are false."""
    kind = kind_of(scope.type_of(column))
    if kind == "boolean":
        test = column
    elif kind == "number":
        test = (column != 0) & ~F.isnan(column.cast("double"))
    elif kind == "string":
        test = column != ""
    else:
        test = column.isNotNull()
    return F.coalesce(test, F.lit(False))


def _size(spec: Any, scope: Scope) -> Column:
    (a,) = _args(spec[0] if isinstance(spec, list) and len(spec) == 1 else spec, scope) if not isinstance(spec, list) or len(spec) == 1 else [compile_expr(spec, scope)]
    return F.coalesce(F.size(a), F.lit(0)) if isinstance(scope.type_of(a), T.ArrayType) else F.lit(0)


def _sum(spec: Any, scope: Scope) -> Column:
    if isinstance(spec, (list, tuple)):
        return reduce(lambda a, b: a + b, (F.coalesce(x.cast("double"), F.lit(0.0)) for x in _args(spec, scope)), F.lit(0.0))
    value = compile_expr(spec, scope)
    kind = scope.type_of(value)
    if not isinstance(kind, T.ArrayType) or kind_of(kind.elementType) != "number":
        return F.lit(0)
    to = "long" if isinstance(kind.elementType, T.IntegralType) else "double"
    return F.coalesce(F.aggregate(value, F.lit(0).cast(to), lambda s, x: s + F.coalesce(x.cast(to), F.lit(0).cast(to))), F.lit(0).cast(to))


def _fold(f: Callable[[Column, Column], Column]) -> Callable:
    return lambda spec, scope: reduce(f, _args(spec, scope))


def _logic(f: Callable[[Column, Column], Column], empty: bool) -> Callable:
    return lambda spec, scope: reduce(f, (truthy(x, scope) for x in _args(spec, scope)), F.lit(empty))


def _compare(f: Callable[[Column, Column], Column], otherwise: bool = False) -> Callable:
    def run(spec: Any, scope: Scope) -> Column:
        a, b = _args(spec, scope)
        ka, kb = kind_of(scope.type_of(a)), kind_of(scope.type_of(b))
        if ka != kb and "null" not in (ka, kb) and {ka, kb} != {"date", "string"}:
            return F.lit(otherwise)
        return F.coalesce(f(a, b), F.lit(otherwise))

    return run


def _cond(spec: Any, scope: Scope) -> Column:
    test, yes, no = (spec["if"], spec["then"], spec["else"]) if isinstance(spec, Mapping) else spec
    return F.when(truthy(compile_expr(test, scope), scope), compile_expr(yes, scope)).otherwise(compile_expr(no, scope))


def _one(f: Callable[[Column], Column]) -> Callable:
    return lambda spec, scope: f(*_args(spec, scope))


def _two(f: Callable[[Column, Column], Column]) -> Callable:
    return lambda spec, scope: f(*_args(spec, scope))


OPERATORS: dict[str, Callable[[Any, Scope], Column]] = {
    "$size": _size,
    "$sum": _sum,
    "$add": _fold(lambda a, b: a + b),
    "$multiply": _fold(lambda a, b: a * b),
    "$eq": _compare(lambda a, b: a.eqNullSafe(b)),
    "$gt": _compare(lambda a, b: a > b),
    "$and": _logic(lambda a, b: a & b, True),
    "$or": _logic(lambda a, b: a | b, False),
    "$year": _one(F.year),
    "$cond": _cond,
    # Extensions, so that stages compose; each is one built-in function.
    "$subtract": _two(lambda a, b: a - b),
    "$divide": _two(lambda a, b: F.try_divide(a, b)),
    "$mod": _two(lambda a, b: F.try_mod(a, b)),
    "$ne": _compare(lambda a, b: ~a.eqNullSafe(b), True),
    "$gte": _compare(lambda a, b: a >= b),
    "$lt": _compare(lambda a, b: a < b),
    "$lte": _compare(lambda a, b: a <= b),
    "$not": lambda spec, scope: ~truthy(_args(spec, scope)[0], scope),
    "$ifNull": lambda spec, scope: F.coalesce(*_args(spec, scope)),
    "$concat": lambda spec, scope: F.concat(*_args(spec, scope)),
    "$toLower": _one(F.lower),
    "$toUpper": _one(F.upper),
    "$month": _one(F.month),
    "$dayOfMonth": _one(F.dayofmonth),
    "$hour": _one(F.hour),
    "$in": _two(lambda a, b: F.coalesce(F.array_contains(b, a), F.lit(False))),
    "$arrayElemAt": _two(lambda a, i: F.get(a, F.when(i < 0, F.size(a) + i).otherwise(i))),
    "$slice": lambda spec, scope: F.slice(*_args(spec, scope)) if len(spec) == 3 else F.slice(compile_expr(spec[0], scope), 1 if spec[1] >= 0 else spec[1], abs(spec[1])),
    "$literal": lambda spec, scope: literal(spec),
    "$round": lambda spec, scope: F.round(compile_expr(spec[0], scope), spec[1]),
}
