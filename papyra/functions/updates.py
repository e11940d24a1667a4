"""Update documents as Columns: {column: new value} of a matched (or inserted) row."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.filters import _field, _sure, equals
from papyra.functions.paths import Scope, kind_of, literal, name


class Draft:
    """The fields of a row while operators are applied to it, one after the other."""

    def __init__(self, scope: Scope):
        self.scope = scope
        self.changed: dict[str, Column] = {}
        self.kinds: dict[str, T.DataType] = {f.name: f.dataType for f in scope.schema.fields}

    def get(self, field: str) -> tuple[Column, T.DataType]:
        if field in self.changed:
            return self.changed[field], self.kinds[field]
        return (name(field), self.kinds[field]) if field in self.kinds else (F.lit(None), T.NullType())

    def put(self, field: str, value: Column) -> None:
        top, _, rest = field.partition(".")
        if rest and field not in self.kinds and isinstance(self.kinds.get(top), T.StructType):
            field, value = top, F.coalesce(self.get(top)[0], F.lit(None).cast(self.kinds[top])).withField(rest, value)
        self.changed[field] = value
        if field not in self.kinds or kind_of(self.kinds[field]) in ("null", "number"):
            self.kinds[field] = self.scope.type_of(value)


def as_kind(value: Any, kind: T.DataType) -> Column:
    """A literal, cast to a field's type where it is of another kind (numbers stay as they are)."""
    column = literal(value)
    if value is None or isinstance(kind, T.NullType) or kind_of(kind) == kind_of(value) == "number":
        return column
    return column if isinstance(kind, T.StructType) and isinstance(value, Mapping) and set(value) != set(kind.names) else column.cast(kind)


def _number(draft: Draft, field: str) -> Column:
    column, kind = draft.get(field)
    return F.coalesce(column, F.lit(0)) if kind_of(kind) == "number" else F.lit(0)


def _array(draft: Draft, field: str, item: Any = None) -> tuple[Column, T.DataType]:
    """An array field, empty where it is missing."""
    column, kind = draft.get(field)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(column, F.array().cast(kind)), kind.elementType
    if not isinstance(kind, T.NullType):
        raise TypeError(f"{field} isn't an array")
    element = draft.scope.type_of(literal(item)) if item is not None else T.StringType()
    return F.array().cast(T.ArrayType(element)), element


def _set(draft: Draft, field: str, value: Any) -> None:
    draft.put(field, as_kind(value, draft.scope.typed(field)[1] if "." in field else draft.get(field)[1]))


def _unset(draft: Draft, field: str, _: Any) -> None:
    kind = draft.scope.typed(field)[1] if "." in field else draft.get(field)[1]
    draft.put(field, F.lit(None).cast(kind))


def _least(draft: Draft, field: str, value: Any) -> None:
    draft.put(field, F.least(draft.get(field)[0], as_kind(value, draft.get(field)[1])))


def _greatest(draft: Draft, field: str, value: Any) -> None:
    draft.put(field, F.greatest(draft.get(field)[0], as_kind(value, draft.get(field)[1])))


def _rename(draft: Draft, field: str, to: str) -> None:
    """Moves a value if there is one; else the target keeps its own."""
    column, kind = draft.get(field)
    if to in draft.kinds:
        column = F.coalesce(column, draft.get(to)[0])
    draft.put(to, column)
    draft.put(field, F.lit(None).cast(kind))


def _current_date(draft: Draft, field: str, how: Any) -> None:
    date = how is True or how == "date" or (isinstance(how, Mapping) and how.get("$type") == "date")
    draft.put(field, F.current_timestamp() if date else F.unix_millis(F.current_timestamp()))


def _items(value: Any) -> list:
    return list(value["$each"]) if isinstance(value, Mapping) and "$each" in value else [value]


def _push(draft: Draft, field: str, value: Any) -> None:
    for item in _items(value):
        column, element = _array(draft, field, item)
        draft.put(field, F.concat(column, F.array(as_kind(item, element).cast(element))))


def _holds(column: Column, value: Column) -> Column:
    return F.exists(column, lambda x: x.eqNullSafe(value))


def _add_to_set(draft: Draft, field: str, value: Any) -> None:
    for item in _items(value):
        column, element = _array(draft, field, item)
        new = as_kind(item, element).cast(element)
        draft.put(field, F.when(_holds(column, new), column).otherwise(F.concat(column, F.array(new))))


def _pull(draft: Draft, field: str, value: Any) -> None:
    column, element = _array(draft, field)
    if isinstance(value, Mapping) and not any(k.startswith("$") for k in value) and isinstance(element, T.StructType):
        hit = lambda x: reduce(lambda a, b: a & b, (_sure(_field(x.getField(k), element[k].dataType, v, draft.scope)) for k, v in value.items()))
    elif isinstance(value, Mapping):
        hit = lambda x: _sure(_field(x, element, value, draft.scope))
    else:
        hit = lambda x: _sure(equals(x, element, value))
    draft.put(field, F.filter(column, lambda x: ~hit(x)))


def _pull_all(draft: Draft, field: str, values: list) -> None:
    column, element = _array(draft, field)
    draft.put(field, F.filter(column, lambda x: ~reduce(lambda a, b: a | b, (_sure(equals(x, element, v)) for v in values), F.lit(False))))


def _pop(draft: Draft, field: str, end: int) -> None:
    column, _ = _array(draft, field)
    keep = F.greatest(F.size(column) - 1, F.lit(0))
    draft.put(field, F.slice(column, F.lit(2 if end == -1 else 1), keep))


def _bit(draft: Draft, field: str, ops: Mapping[str, int]) -> None:
    column, kind = draft.get(field)
    if kind_of(kind) != "number":
        raise TypeError(f"{field} isn't a number")
    for op, value in ops.items():
        if op not in ("and", "or", "xor"):
            raise ValueError(f"unknown bit operation {op}")
        whole, other = column.cast("int"), F.lit(value).cast("int")
        column = {"and": whole.bitwiseAND, "or": whole.bitwiseOR, "xor": whole.bitwiseXOR}[op](other)
    draft.put(field, column.cast(kind) if isinstance(kind, T.IntegralType) else column)


OPERATORS: dict[str, Callable[[Draft, str, Any], None]] = {
    "$set": _set,
    "$unset": _unset,
    "$inc": lambda d, f, v: d.put(f, _number(d, f) + literal(v)),
    "$mul": lambda d, f, v: d.put(f, _number(d, f) * literal(v)),
    "$min": _least,
    "$max": _greatest,
    "$rename": _rename,
    "$currentDate": _current_date,
    "$push": _push,
    "$pull": _pull,
    "$pullAll": _pull_all,
    "$addToSet": _add_to_set,
    "$pop": _pop,
    "$bit": _bit,
}


def compile_update(update: Mapping[str, Any], scope: Scope, insert: bool = False) -> dict[str, Column]:
    """The changed columns. Operators apply in the order of their keys; a document without operators assigns fields.

    $setOnInsert counts only with insert. Null fields are missing: $inc and $mul start from 0, $min and $max take the
    given value, array operators start from an empty array.
    """
    draft = Draft(scope)
    if not any(k.startswith("$") for k in update):
        update = {"$set": update}
    for op, fields in update.items():
        if op == "$setOnInsert":
            if not insert:
                continue
            op = "$set"
        if op not in OPERATORS:
            raise ValueError(f"unknown update operator {op}")
        for field, value in fields.items():
            OPERATORS[op](draft, field, value)
    return draft.changed
