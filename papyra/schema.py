"""Schemas: declared fields with casts, defaults, validators, virtual fields and hooks."""

from __future__ import annotations

import copy
import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.filters import _sure, matches
from papyra.functions.paths import Scope, kind_of, literal, name
from papyra.types import fit, infer, merge_all, named

HOOKS = ("init", "validate", "save", "remove", "deleteOne", "deleteMany", "find", "aggregate")


class ValidationError(ValueError):
    pass


def _pair(rule: Any, message: str) -> tuple[Any, str]:
    """(value, message) of a rule given as a value, [value, message] or {value, message}."""
    if isinstance(rule, Mapping):
        return rule["value"], rule.get("message", message)
    if isinstance(rule, (list, tuple)) and len(rule) == 2 and isinstance(rule[1], str):
        return rule[0], rule[1]
    return rule, message


class Field:
    """One declared path: type, options, and what they mean as Columns and for single values."""

    def __init__(self, path: str, kind: str, data_type: T.DataType, options: Mapping[str, Any] | None = None, schema: "Schema | None" = None):
        self.path, self.kind, self.data_type, self.options, self.schema = path, kind, data_type, dict(options or {}), schema
        self.validators: list[tuple[str, Any, str]] = []
        self.setters: list[Callable[[Column], Column]] = []
        self.getters: list[Callable[[Column], Column]] = []
        for rule in ("min", "max", "minlength", "maxlength", "match", "enum"):
            if rule in self.options:
                self._rule(rule, self.options[rule])
        if (v := self.options.get("validate")) is not None:
            for one in v if isinstance(v, list) else [v]:
                self.validate(*((one["validator"], one.get("message")) if isinstance(one, Mapping) else (one, None)))
        for how, f in (("trim", F.trim), ("lowercase", F.lower), ("uppercase", F.upper), ("set", None)):
            if self.options.get(how):
                self.setters.append(f or self.options[how])
        if self.options.get("get"):
            self.getters.append(self.options["get"])

    def _rule(self, rule: str, given: Any) -> "Field":
        if rule == "enum":
            given = given["values"] if isinstance(given, Mapping) else given
            value, message = list(given), f"{self.path} isn't an allowed value"
        else:
            words = {"min": "is less than", "max": "is more than", "minlength": "is shorter than", "maxlength": "is longer than", "match": "doesn't match"}
            value, message = _pair(given, "")
            shown = value.pattern if isinstance(value, re.Pattern) else value
            message = message or f"{self.path} {words[rule]} {shown}"
        self.validators.append((rule, value, message))
        return self

    # Fluent setters of options.
    def min(self, value: Any, message: str | None = None) -> "Field":
        return self._rule("min", [value, message] if message else value)

    def max(self, value: Any, message: str | None = None) -> "Field":
        return self._rule("max", [value, message] if message else value)

    def match(self, pattern: Any, message: str | None = None) -> "Field":
        return self._rule("match", [pattern, message] if message else pattern)

    def enum(self, *values: Any) -> "Field":
        return self._rule("enum", values)

    def validate(self, check: Callable[[Column], Column], message: str | None = None) -> "Field":
        """check takes the field as a Column and returns a boolean Column; null results pass."""
        self.validators.append(("custom", check, message or f"{self.path} is invalid"))
        return self

    def validate_all(self, df: Any) -> bool:
        """Whether every validator of this field holds for all rows of a DataFrame; one aggregate."""
        broken = [c for _, c in self.violations(name(self.path))] if self.path in df.columns else []
        return not broken or df.where(F.greatest(*broken, F.lit(False))).isEmpty()

    def required(self, on: bool | str | list = True) -> "Field":
        self.options["required"] = on
        return self

    def default(self, value: Any) -> "Field":
        self.options["default"] = value
        return self

    def _option(self, key: str, value: Any = True) -> "Field":
        self.options[key] = value
        return self

    def __getattr__(self, key: str) -> Callable[..., "Field"]:
        if key in ("sparse", "unique", "text", "index", "immutable", "ref", "select", "transform"):
            return lambda value=True: self._option(key, value)
        raise AttributeError(key)

    def get(self, f: Callable[[Column], Column]) -> "Field":
        self.getters.append(f)
        return self

    def set(self, f: Callable[[Column], Column]) -> "Field":
        self.setters.append(f)
        return self

    def trim(self) -> "Field":
        return self.set(F.trim)

    def lowercase(self) -> "Field":
        return self.set(F.lower)

    def uppercase(self) -> "Field":
        return self.set(F.upper)

    def get_default(self) -> Any:
        value = self.options.get("default")
        return value() if callable(value) else value

    @property
    def is_required(self) -> tuple[bool, str]:
        on, message = _pair(self.options.get("required", False), f"{self.path} is required")
        return bool(on), message

    def cast(self, column: Column, given: T.DataType) -> Column:
        """The column in the declared type (null where it doesn't fit), then the setters."""
        if given != self.data_type:
            if isinstance(self.data_type, T.BooleanType) and kind_of(given) == "string":
                column = column != ""
            elif isinstance(self.data_type, T.BooleanType) and kind_of(given) == "number":
                column = column != 0
            elif isinstance(self.data_type, T.VariantType):
                column = F.to_variant_object(column) if isinstance(given, (T.StructType, T.ArrayType, T.MapType)) else column.cast("variant")
            elif isinstance(self.data_type, T.StructType) and isinstance(given, T.StructType):
                column = F.when(column.isNotNull(), F.struct(*((column.getField(f.name).cast(f.dataType) if f.name in given.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.data_type.fields)))
            elif isinstance(given, (T.StructType, T.MapType)) or isinstance(self.data_type, (T.StructType, T.MapType)):
                column = column.cast(self.data_type)
            elif isinstance(self.data_type, T.TimestampType) and kind_of(given) == "number":
                column = F.timestamp_millis(column.cast("long"))
            else:
                column = column.try_cast(self.data_type)
        for f in self.setters:
            column = f(column)
        return column

    def violations(self, column: Column) -> list[tuple[str, Column]]:
        """(message, Column that is true where the field is wrong)."""
        out = []
        on, message = self.is_required
        if on:
            out.append((message, column.isNull()))
        for rule, value, message in self.validators:
            if rule == "min":
                bad = column < literal(value)
            elif rule == "max":
                bad = column > literal(value)
            elif rule == "minlength":
                bad = F.length(column) < value
            elif rule == "maxlength":
                bad = F.length(column) > value
            elif rule == "enum":
                bad = ~column.isin(*value)
            elif rule == "match":
                bad = column.isNotNull() & ~matches(column, self.data_type, value, "")
            else:
                bad = ~value(column)
            out.append((message, _sure(bad)))
        return out

    def to_json_schema(self) -> dict:
        kind = {"number": "number", "string": "string", "boolean": "boolean", "date": "string", "array": "array"}.get(kind_of(self.data_type), "object")
        out: dict[str, Any] = {"type": "integer" if isinstance(self.data_type, T.IntegralType) else kind}
        if kind_of(self.data_type) == "date":
            out["format"] = "date-time"
        keys = {"min": "minimum", "max": "maximum", "minlength": "minLength", "maxlength": "maxLength", "enum": "enum", "match": "pattern"}
        for rule, value, _ in self.validators:
            if rule in keys:
                out[keys[rule]] = value.pattern if isinstance(value, re.Pattern) else value
        if self.schema is not None:
            inner = self.schema.to_json_schema()
            out = {"type": "array", "items": inner} if isinstance(self.data_type, T.ArrayType) else {**out, **inner}
        return out


class Virtual:
    """A computed field: getters are chained from null, each a function (value, row scope) -> Column; setters write dicts."""

    def __init__(self, path: str, options: Mapping[str, Any] | None = None):
        self.path, self.options = path, dict(options or {})
        self.getters: list[Callable] = []
        self.setters: list[Callable] = []

    def get(self, f: Callable) -> "Virtual":
        """f takes a function that gives any field of the document as a Column (or, on a Document, its value)."""
        self.getters.append(f)
        return self

    def set(self, f: Callable) -> "Virtual":
        """f takes the new value and the document."""
        self.setters.append(f)
        return self

    def column(self, scope: Scope) -> Column | None:
        out = None
        for f in self.getters:
            out = f(scope.path)
        return out

    @property
    def populates(self) -> bool:
        return "ref" in self.options


class Schema:
    def __init__(self, definition: Mapping[str, Any] | None = None, timestamps: bool = True, version_key: bool | str = True, strict: bool = False, **options: Any):
        self.options = {"timestamps": timestamps, "version_key": version_key, "strict": strict, **options}
        self.fields: dict[str, Field] = {}
        self.virtuals: dict[str, Virtual] = {}
        self.methods: dict[str, Callable] = {}
        self.statics: dict[str, Callable] = {}
        self.pres: dict[str, list[Callable]] = {}
        self.posts: dict[str, list[Callable]] = {}
        self._indexes: list[tuple[dict, dict]] = []
        self._plugins: list[Callable] = []
        self.aliases: dict[str, str] = {}
        self.discriminators: dict[str, Schema] = {}
        self._version: Any = None
        self.add(definition or {})

    # Definition.
    def _field(self, path: str, given: Any) -> Field:
        if isinstance(given, Field):
            return given
        if isinstance(given, Schema):
            return Field(path, "Object", given.struct(bare=True), schema=given)
        if isinstance(given, list):
            item = self._field(path, given[0]) if given else Field(path, "String", T.StringType())
            return Field(path, "Array", T.ArrayType(item.data_type), schema=item.schema)
        if isinstance(given, Mapping) and "type" in given and not (isinstance(given["type"], Mapping) and "type" in given["type"]):
            options = {k: v for k, v in given.items() if k != "type"}
            inner = self._field(path, given["type"]) if isinstance(given["type"], (Schema, list, Mapping)) else Field(path, *named(given["type"]))
            kind = inner.data_type
            default = options.get("default")
            if inner.kind in ("Array", "Object") and inner.schema is None and not callable(default) and default and isinstance(kind, (T.VariantType, T.ArrayType)):
                kind = infer(default)  # a declared default shows what an untyped array or object holds
            return Field(path, inner.kind, kind, options, inner.schema)
        if isinstance(given, Mapping):
            inner = Schema(given, timestamps=False, version_key=False)
            return Field(path, "Object", inner.struct(bare=True), schema=inner)
        return Field(path, *named(given))

    def add(self, other: "Schema | Mapping[str, Any]") -> "Schema":
        if isinstance(other, Schema):
            return self.extend(other)
        for path, given in other.items():
            self.fields[path] = self._field(path, given)
            if (index := self.fields[path].options.get("index")) or self.fields[path].options.get("unique"):
                self.index({path: 1 if index in (True, None) else index}, unique=bool(self.fields[path].options.get("unique")))
            if alias := self.fields[path].options.get("alias"):
                self.alias(path, alias)
        return self

    def remove(self, *paths: str) -> "Schema":
        for p in paths:
            self.fields.pop(p, None)
        return self

    def extend(self, other: "Schema | Mapping") -> "Schema":
        if not isinstance(other, Schema):
            return self.add(other)
        for mine, theirs in ((self.fields, other.fields), (self.methods, other.methods), (self.statics, other.statics), (self.virtuals, other.virtuals), (self.aliases, other.aliases)):
            mine.update(theirs)
        for mine, theirs in ((self.pres, other.pres), (self.posts, other.posts)):
            for event, hooks in theirs.items():
                mine.setdefault(event, []).extend(hooks)
        self._indexes += other._indexes
        return self

    def clone(self) -> "Schema":
        out = copy.copy(self)
        for k in ("fields", "virtuals", "methods", "statics", "aliases", "options", "discriminators"):
            setattr(out, k, dict(getattr(self, k)))
        out.pres, out.posts = ({k: list(v) for k, v in hooks.items()} for hooks in (self.pres, self.posts))
        out._indexes, out._plugins = list(self._indexes), list(self._plugins)
        return out

    def pick(self, paths: Iterable[str]) -> "Schema":
        out, wanted = self.clone(), set(paths)
        out.fields = {k: v for k, v in self.fields.items() if k in wanted}
        return out

    def omit(self, paths: Iterable[str]) -> "Schema":
        return self.pick(set(self.fields) - set(paths))

    def alias(self, path: str, alias: str) -> "Schema":
        self.aliases[alias] = path
        self.virtual(alias).get(lambda field: field(path))
        return self

    def virtual(self, path: str, options: Mapping[str, Any] | None = None) -> Virtual:
        self.virtuals[path] = Virtual(path, options)
        return self.virtuals[path]

    def method(self, key: str | Mapping[str, Callable], f: Callable | None = None) -> "Schema":
        self.methods.update(key if isinstance(key, Mapping) else {key: f})
        return self

    def static(self, key: str | Mapping[str, Callable], f: Callable | None = None) -> "Schema":
        self.statics.update(key if isinstance(key, Mapping) else {key: f})
        return self

    def load_class(self, cls: type) -> "Schema":
        """Methods, static methods and properties (as virtual fields of documents) of a class."""
        for key, x in vars(cls).items():
            if key.startswith("_"):
                continue
            if isinstance(x, (staticmethod, classmethod)):
                self.statics[key] = x.__func__
            elif isinstance(x, property):
                self.methods[key] = x.fget
            elif callable(x):
                self.methods[key] = x
        return self

    def pre(self, event: str, hook: Callable) -> "Schema":
        return self._hook(self.pres, event, hook)

    def post(self, event: str, hook: Callable) -> "Schema":
        return self._hook(self.posts, event, hook)

    def _hook(self, hooks: dict, event: str, hook: Callable) -> "Schema":
        if event not in HOOKS:
            raise ValueError(f"unknown hook {event}")
        hooks.setdefault(event, []).append(hook)
        return self

    def plugin(self, f: Callable, **options: Any) -> "Schema":
        if f not in self._plugins:
            self._plugins.append(f)
            f(self, **options)
        return self

    def discriminator(self, key: str, schema: "Schema") -> "Schema":
        out = self.clone().extend(schema)
        self.discriminators[key] = out
        return out

    def get(self, option: str) -> Any:
        return self.options.get(option)

    def set(self, option: str, value: Any) -> "Schema":
        self.options[option] = value
        return self

    def queue(self, method: str, args: list | None = None) -> "Schema":
        """Runs the named method on each document that is made."""
        self.options.setdefault("queue", []).append((method, list(args or ())))
        return self

    def version(self, value: Any = None) -> Any:
        if value is None:
            return self._version
        self._version = value
        return self

    # Indexes are metadata: `unique` is checked on writes, 'text' names the fields of text search.
    def index(self, fields: Mapping[str, Any], **options: Any) -> "Schema":
        for path, way in fields.items():
            if way not in (1, -1, "text", "2d", "2dsphere", "hashed", "1", "-1", "asc", "desc"):
                raise ValueError(f"unknown index type {way!r} of {path}")
        self._indexes.append((dict(fields), options))
        return self

    search_index = index

    def indexes(self) -> list[tuple[dict, dict]]:
        return list(self._indexes)

    def clear_indexes(self) -> "Schema":
        self._indexes.clear()
        return self

    def remove_index(self, fields: Mapping[str, Any]) -> "Schema":
        self._indexes = [x for x in self._indexes if x[0] != dict(fields)]
        return self

    @staticmethod
    def index_types() -> list[str]:
        return ["2d", "2dsphere", "hashed", "text"]

    def text_fields(self) -> list[str]:
        return [p for fields, _ in self._indexes for p, way in fields.items() if way == "text"]

    def unique_fields(self) -> list[list[str]]:
        return [list(fields) for fields, options in self._indexes if options.get("unique")]

    # Introspection.
    def path(self, path: str, given: Any = None) -> Field | None:
        if given is not None:
            self.add({path: given})
        first, _, rest = path.partition(".")
        if path in self.fields or not rest:
            return self.fields.get(path)
        outer = self.fields.get(first)
        return outer.schema.path(rest) if outer and outer.schema else None

    def path_type(self, path: str) -> str:
        if path in self.virtuals:
            return "virtual"
        found = self.path(path)
        return "adhocOrUndefined" if found is None else "nested" if found.schema and not isinstance(found.data_type, T.ArrayType) else "real"

    def each_path(self, f: Callable[[str, Field], None]) -> "Schema":
        for path, field in self.fields.items():
            f(path, field)
        return self

    def paths(self) -> dict[str, Field]:
        return dict(self.fields)

    def required_paths(self) -> list[str]:
        return [p for p, f in self.fields.items() if f.is_required[0]]

    def nested(self) -> list[str]:
        return [p for p in self.fields if self.path_type(p) == "nested"]

    def is_array(self, path: str) -> bool:
        found = self.path(path)
        return found is not None and isinstance(found.data_type, T.ArrayType)

    def virtual_path(self, path: str) -> Virtual | None:
        return self.virtuals.get(path)

    def struct(self, bare: bool = False) -> T.StructType:
        """The stored fields; unless bare, with _id, times and version."""
        out = T.StructType([T.StructField(p, f.data_type) for p, f in self.fields.items() if bare or p not in ("_id", "createdAt", "updatedAt", "__v")])
        if bare:
            return out
        tail = []
        if self.options["timestamps"]:
            tail += [T.StructField("createdAt", T.TimestampType()), T.StructField("updatedAt", T.TimestampType())]
        if self.options["version_key"]:
            tail.append(T.StructField("__v", T.IntegerType()))
        return T.StructType([T.StructField("_id", T.StringType()), *out.fields, *tail])

    def to_json_schema(self) -> dict:
        out: dict[str, Any] = {"type": "object", "properties": {p: f.to_json_schema() for p, f in self.fields.items()}}
        if required := self.required_paths():
            out["required"] = required
        return out

    # Rows.
    def frame(self, spark, docs: list[Mapping[str, Any]]) -> DataFrame:
        """Documents as a DataFrame: declared fields with whatever type they come in, undeclared ones inferred (unless strict)."""
        names = dict.fromkeys(k for d in docs for k in d)
        if self.options["strict"]:
            names = {k: None for k in names if k in self.fields or k in ("_id", "createdAt", "updatedAt", "__v")}
        kinds = {}
        for k in names:
            given = merge_all(infer(d.get(k)) for d in docs)
            declared = self.fields[k].data_type if k in self.fields else None
            exact = declared is not None and isinstance(declared, (T.StructType, T.ArrayType, T.MapType)) and kind_of(given) in (kind_of(declared), "null")
            kinds[k] = declared if exact else given
        held = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
        return spark.createDataFrame([tuple(fit(d.get(f.name), f.dataType) for f in held.fields) for d in docs], held)

    def defaults(self, doc: Mapping[str, Any]) -> dict[str, Any]:
        """doc with the defaults of missing fields."""
        out = dict(doc)
        for p, f in self.fields.items():
            if out.get(p) is None and "default" in f.options:
                out[p] = copy.deepcopy(f.get_default())
            elif f.schema is not None and isinstance(out.get(p), Mapping):
                out[p] = f.schema.defaults(out[p])
        return out

    def prepared(self, df: DataFrame, now: dt.datetime | None = None) -> DataFrame:
        """Rows as they are stored: casts and setters, defaults, ids, times, version. One projection, no shuffle."""
        out: dict[str, Column] = {}
        when = F.lit(now) if now is not None else F.current_timestamp()
        if "_id" in df.columns:
            out["_id"] = F.coalesce(name("_id").cast("string"), new_id())
        else:
            out["_id"] = new_id()
        for p, f in self.fields.items():
            column = f.cast(name(p), df.schema[p].dataType) if p in df.columns else F.lit(None).cast(f.data_type)
            default = f.get_default()
            if default is not None:
                column = F.coalesce(column, F.parse_json(F.to_json(literal(default))) if isinstance(f.data_type, T.VariantType) and isinstance(default, (dict, list)) else literal(default).cast(f.data_type) if not (isinstance(default, (list, dict)) and not default) else F.array().cast(f.data_type) if isinstance(f.data_type, T.ArrayType) else F.lit(None).cast(f.data_type))
            if p not in ("_id", "createdAt", "updatedAt", "__v"):
                out[p] = column
        if not self.options["strict"]:
            out |= {c: name(c) for c in df.columns if c not in out and c not in ("createdAt", "updatedAt", "__v")}
        if self.options["timestamps"]:
            out |= {c: F.coalesce(name(c).cast("timestamp"), when) if c in df.columns else when for c in ("createdAt", "updatedAt")}
        if self.options["version_key"]:
            out["__v"] = F.lit(0)
        return df.select(*(c.alias(k) for k, c in out.items()))

    def violations(self, scope: Scope, only: Iterable[str] | None = None) -> list[tuple[str, Column]]:
        out = []
        for p, f in self.fields.items():
            if only is not None and p not in set(only):
                continue
            column = scope.path(p)
            out += f.violations(column)
            if f.schema is not None and isinstance(f.data_type, T.StructType):
                for q, g in f.schema.fields.items():
                    out += [(f"{p}.{message}", column.isNotNull() & bad) for message, bad in g.violations(column.getField(q))]
        return out

    def check(self, df: DataFrame, only: Iterable[str] | None = None) -> None:
        """Raises a ValidationError that names every rule that some row breaks; one aggregate over df."""
        rules = self.violations(Scope(df), only)
        if not rules:
            return
        row = df.agg(*(F.count_if(bad).alias(f"v{i}") for i, (_, bad) in enumerate(rules))).first()
        broken = [message for i, (message, _) in enumerate(rules) if row[i]]
        if broken:
            raise ValidationError(", ".join(dict.fromkeys(broken)))

    def rejects(self, df: DataFrame) -> DataFrame:
        """The rows that break a rule, with the messages as an array, `errors`."""
        rules = self.violations(Scope(df))
        errors = F.filter(F.array(*(F.when(bad, F.lit(message)) for message, bad in rules)), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
        return df.withColumn("errors", errors).where("size(errors) > 0")

    def with_virtuals(self, df: DataFrame) -> DataFrame:
        """df with getters applied and the virtual fields that have getters, computed from stored fields."""
        got = {p: name(p) for p, f in self.fields.items() if f.getters and p in df.columns}
        for p in got:
            for f in self.fields[p].getters:
                got[p] = f(got[p])
        if got:
            df = df.withColumns(got)
        scope = Scope(df)
        found = {p: c for p, v in self.virtuals.items() if not v.populates and (c := v.column(scope)) is not None}
        return df.withColumns(found) if found else df


def new_id() -> Column:
    """24 hex digits: seconds, then random bits; differs in each row."""
    return F.concat(F.lower(F.lpad(F.hex(F.unix_seconds(F.current_timestamp())), 8, "0")), F.substring(F.translate(F.expr("uuid()"), "-", ""), 1, 16))
