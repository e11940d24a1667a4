"""Group accumulators as aggregate Columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.expressions import compile_expr
from papyra.functions.paths import Scope, kind_of

Order = list[tuple[str, int]]


def ascending(order: Order, scope: Scope) -> Column | None:
    """A struct that sorts upwards as order does, or None if a descending key can't be negated."""
    keys = []
    for path, way in order:
        column, kind = scope.typed(path)
        if way < 0:
            if kind_of(kind) == "number":
                column = -column.cast("double")
            elif isinstance(kind, T.TimestampType):
                column = -F.unix_micros(column)
            elif isinstance(kind, (T.TimestampNTZType, T.DateType)):
                column = -F.unix_micros(column.cast("timestamp"))
            else:
                return None
            # Nulls come last when descending.
            keys.append(column.isNull())
        keys.append(column)
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))) if keys else None


def pushed(value: Column, order: Order | None, scope: Scope) -> Column:
    """All values, nulls included, in the given order."""
    if not order:
        return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])
    key = F.struct(*(scope.path(p).alias(f"c{i}") for i, (p, _) in enumerate(order)))
    held = F.collect_list(F.struct(key.alias("k"), value.alias("v")))
    return F.transform(F.array_sort(held, lambda a, b: _compare_columns(a, b, order)), lambda x: x["v"])


def _compare_columns(a: Column, b: Column, order: Order) -> Column:
    out = F.lit(0)
    for i, (_, way) in reversed(list(enumerate(order))):
        x, y = a["k"][f"c{i}"], b["k"][f"c{i}"]
        less, more = (F.lit(-1), F.lit(1)) if way > 0 else (F.lit(1), F.lit(-1))
        out = F.when(x.eqNullSafe(y), out).when(x.isNull(), less).when(y.isNull(), more).when(x < y, less).otherwise(more)
    return out


def compile_accumulator(spec: Mapping[str, Any], scope: Scope, order: Order | None = None) -> Column:
    """order: the keys of a $sort before the group, by which $first, $last and $push go."""
    if len(spec) != 1:
        raise ValueError(f"an accumulator has one operator: {sorted(spec)}")
    ((op, arg),) = spec.items()
    if op == "$count":
        return F.count(F.lit(1))
    if op == "$sum":
        if isinstance(arg, (int, float)) and not isinstance(arg, bool):
            return F.count(F.lit(1)) * F.lit(arg)
        value = compile_expr(arg, scope)
        return F.coalesce(F.sum(value), F.lit(0)) if kind_of(scope.type_of(value)) == "number" else F.sum(F.lit(0))
    value = compile_expr(arg, scope)
    if op == "$avg":
        return F.avg(value)
    if op in ("$min", "$max"):
        return F.min(value) if op == "$min" else F.max(value)
    if op == "$push":
        return pushed(value, order, scope)
    if op == "$addToSet":
        return F.array_sort(F.collect_set(value))
    if op == "$stdDevPop":
        return F.stddev_pop(value)
    if op == "$stdDevSamp":
        return F.stddev_samp(value)
    if op in ("$first", "$last"):
        key = ascending(order, scope) if order else None
        if order and key is None:
            held = pushed(value, order, scope)
            return F.get(F.filter(held, lambda x: x.isNotNull()), 0) if op == "$first" else F.element_at(held, -1)
        if not order:
            return F.first(value, ignorenulls=True) if op == "$first" else F.last(value)
        if op == "$first":
            return F.min_by(value, F.when(value.isNotNull(), key))
        return F.max_by(F.struct(value.alias("v")), key)["v"]
    if op == "$mergeObjects":
        kind = scope.type_of(value)
        if isinstance(kind, T.MapType):
            held = pushed(F.coalesce(value, F.create_map().cast(kind)), order, scope)
            return F.aggregate(held, F.create_map().cast(kind), lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))
        key = ascending(order, scope) if order else None
        last = (lambda c: F.max_by(c, F.when(c.isNotNull(), key))) if key is not None else (lambda c: F.last(c, ignorenulls=True))
        return F.struct(*(last(value[f.name]).alias(f.name) for f in kind.fields))
    raise ValueError(f"unknown accumulator {op}")
