"""Queries: an immutable fluent builder that compiles to one DataFrame plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.filters import compile_filter
from papyra.functions.geo import metres_between
from papyra.functions.paths import Scope, name
from papyra.operators.relational import join_key

#: Options that are kept and have no effect on a plan.
IGNORED = ("comment", "max_time_ms", "batch_size", "read", "read_concern", "write_concern", "w", "j", "wtimeout", "session", "tailable", "collation", "allow_disk_use")


def fields_of(spec: str | list | Mapping[str, Any]) -> dict[str, Any]:
    """'a -b' or ['a', '-b'] as {a: 1, b: 0}."""
    if isinstance(spec, Mapping):
        return dict(spec)
    out = {}
    for x in spec.split() if isinstance(spec, str) else spec:
        out[x.lstrip("+-")] = 0 if x.startswith("-") else 1
    return out


def order_of(spec: str | Mapping[str, Any]) -> dict[str, int]:
    """'a -b' or {a: 1, b: 'desc'} as {a: 1, b: -1}."""
    if isinstance(spec, str):
        return {x.lstrip("+-"): -1 if x.startswith("-") else 1 for x in spec.split()}
    return {k: -1 if v in (-1, "-1", "desc", "descending") else 1 for k, v in spec.items()}


class Query:
    """Every method returns a new Query. Conditions on one path add up; nothing runs before df() is used."""

    def __init__(self, source: Callable[[], DataFrame], model: Any = None, conditions: Mapping[str, Any] | None = None):
        self._source, self._model = source, model
        self._conditions: list[Mapping[str, Any]] = [dict(conditions)] if conditions else []
        self._path: str | None = None
        self._fields: dict[str, Any] = {}
        self._order: dict[str, Any] = {}
        self._skip = self._limit = 0
        self._populate: list[dict[str, Any]] = []
        self._lean = False
        self._transforms: list[Callable] = []
        self._slices: dict[str, Any] = {}
        self._scores: dict[str, str] = {}
        self._random: int | None = None
        self._nearest: tuple | None = None
        self._or_fail: Any = None
        self._hint: tuple | None = None
        self._update: Mapping[str, Any] | None = None
        self._options: dict[str, Any] = {}

    def _with(self, **changes: Any) -> "Query":
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def _add(self, condition: Mapping[str, Any]) -> "Query":
        return self._with(_conditions=[*self._conditions, condition])

    # Conditions.
    def where(self, path: str | Mapping[str, Any], value: Any = ...) -> "Query":
        if isinstance(path, Mapping):
            return self._add(path)
        if not path:
            raise ValueError("where takes a path")
        out = self._with(_path=path)
        return out if value is ... else out.equals(value)

    def find(self, conditions: Mapping[str, Any] | None = None) -> "Query":
        return self._add(conditions) if conditions else self

    merge_conditions = find

    def _on(self, op: str, args: tuple) -> "Query":
        if len(args) == 2:
            path, value = args
        else:
            path, value = self._path, args[0] if args else True
        if not path:
            raise ValueError(f"{op} needs a path: where(path) first, or path and value")
        return self._add({path: {op: value}})._with(_path=path)

    def equals(self, value: Any) -> "Query":
        if not self._path:
            raise ValueError("equals needs where(path)")
        return self._add({self._path: value})

    def gt(self, *args: Any) -> "Query":
        return self._on("$gt", args)

    def gte(self, *args: Any) -> "Query":
        return self._on("$gte", args)

    def lt(self, *args: Any) -> "Query":
        return self._on("$lt", args)

    def lte(self, *args: Any) -> "Query":
        return self._on("$lte", args)

    def ne(self, *args: Any) -> "Query":
        return self._on("$ne", args)

    def in_(self, *args: Any) -> "Query":
        return self._on("$in", args)

    def nin(self, *args: Any) -> "Query":
        return self._on("$nin", args)

    def exists(self, *args: Any) -> "Query":
        if len(args) == 1 and isinstance(args[0], str):
            args = (args[0], True)
        return self._on("$exists", args)

    def type(self, *args: Any) -> "Query":
        return self._on("$type", args)

    def mod(self, *args: Any) -> "Query":
        if len(args) == 3:
            args = (args[0], list(args[1:]))
        elif len(args) == 2 and not isinstance(args[0], str):
            args = (list(args),)
        return self._on("$mod", args)

    def size(self, *args: Any) -> "Query":
        return self._on("$size", args)

    def all(self, *args: Any) -> "Query":
        return self._on("$all", args)

    def elem_match(self, *args: Any) -> "Query":
        return self._on("$elemMatch", args)

    def regex(self, *args: Any, options: str | None = None) -> "Query":
        """A pattern given as text ignores case unless options say otherwise."""
        path, pattern = args if len(args) == 2 else (self._path, args[0])
        if isinstance(pattern, re.Pattern):
            return self._on("$regex", (path, pattern))
        if not path:
            raise ValueError("regex needs a path")
        return self._add({path: {"$regex": pattern, "$options": "i" if options is None else options}})

    def and_(self, conditions: list) -> "Query":
        return self._add({"$and": conditions})

    def or_(self, conditions: list) -> "Query":
        return self._add({"$or": conditions})

    def nor(self, conditions: list) -> "Query":
        return self._add({"$nor": conditions})

    def expr(self, spec: Any) -> "Query":
        return self._add({"$expr": spec})

    def json_schema(self, spec: Mapping) -> "Query":
        return self._add({"$jsonSchema": spec})

    def text(self, query: str | Mapping) -> "Query":
        return self._add({"$text": query})

    def where_sql(self, condition: str) -> "Query":
        return self._add({"$where": condition})

    # Areas; points are [longitude, latitude].
    def near(self, *args: Any, spherical: bool = True) -> "Query":
        path, spec = args if len(args) == 2 else (self._path, args[0])
        point = spec.get("center", spec.get("$geometry", spec)) if isinstance(spec, Mapping) else spec
        point = point["coordinates"] if isinstance(point, Mapping) else point
        options = {k: v for k, v in (("$maxDistance", spec.get("maxDistance", spec.get("$maxDistance"))), ("$minDistance", spec.get("minDistance"))) if v is not None} if isinstance(spec, Mapping) else {}
        return self._add({path: {"$near": point, **options}})._with(_path=path, _nearest=(path, tuple(point)))

    near_sphere = near

    def max_distance(self, *args: Any) -> "Query":
        path, far = args if len(args) == 2 else (self._path, args[0])
        last = self._conditions[-1] if self._conditions else {}
        if "$near" not in last.get(path, {}):
            raise ValueError("max_distance follows near")
        return self._with(_conditions=[*self._conditions[:-1], {path: {**last[path], "$maxDistance": far}}])

    def within(self, *args: Any) -> "Query":
        if not args:
            return self
        path, shape = args if len(args) == 2 else (self._path, args[0])
        shape = {k if k.startswith("$") or k in ("type", "coordinates") else "$" + k: v for k, v in shape.items()}
        return self._add({path: {"$geoWithin": shape}})._with(_path=path)

    def _shape(self, kind: str, args: tuple, n: int) -> "Query":
        path, args = (args[0], args[1:]) if isinstance(args[0], str) else (self._path, args)
        shape = list(args) if n else list(args[0]) if len(args) == 1 else list(args)
        return self._add({path: {"$geoWithin": {kind: shape}}})._with(_path=path)

    def box(self, *args: Any) -> "Query":
        return self._shape("$box", args, 2)

    def center(self, *args: Any) -> "Query":
        return self._shape("$center", args, 2)

    circle = center

    def center_sphere(self, *args: Any) -> "Query":
        return self._shape("$centerSphere", args, 2)

    def polygon(self, *args: Any) -> "Query":
        return self._shape("$polygon", args, 0)

    def geometry(self, *args: Any) -> "Query":
        return self.within(*args)

    def intersects(self, *args: Any) -> "Query":
        path, shape = args if len(args) == 2 else (self._path, args[0])
        return self._add({path: {"$geoIntersects": {"$geometry": shape.get("$geometry", shape)}}})

    # Shape of the result.
    def select(self, spec: str | list | Mapping[str, Any]) -> "Query":
        return self._with(_fields={**self._fields, **fields_of(spec)})

    projection = select

    @staticmethod
    def sanitize_projection(fields: Mapping[str, Any]) -> dict[str, int]:
        """The plain choices among fields, as 1 and 0: expressions and other values, as a user may send them, drop out."""
        return {k: int(bool(v)) for k, v in fields.items() if isinstance(v, (bool, int, float))}

    def selected(self) -> bool:
        return bool(self._fields)

    def selected_inclusively(self) -> bool:
        return any(v for k, v in self._fields.items() if k != "_id" or len(self._fields) == 1)

    def selected_exclusively(self) -> bool:
        return bool(self._fields) and not self.selected_inclusively()

    def is_path_selected_inclusive(self, path: str) -> bool:
        return bool(self._fields.get(path))

    def sort(self, spec: str | Mapping[str, Any]) -> "Query":
        return self._with(_order={**self._order, **order_of(spec)})

    def natural(self, way: int = 1) -> "Query":
        return self.sort({"_id": way})

    def rand(self, seed: int = 0) -> "Query":
        return self._with(_random=seed)

    def skip(self, n: int) -> "Query":
        return self._with(_skip=n)

    def limit(self, n: int) -> "Query":
        """0: no limit."""
        return self._with(_limit=n)

    def paginate(self, page: int, per_page: int) -> "Query":
        return self.skip((page - 1) * per_page).limit(per_page)

    def slice(self, path: str, spec: Any) -> "Query":
        """n: the first (negative: last) n elements of an array; [skip, n]."""
        return self._with(_slices={**self._slices, path: spec})

    def meta(self, field: str, query: str) -> "Query":
        """A field with the number of query terms that the document's texts hold."""
        return self._with(_scores={**self._scores, field: query})

    def populate(self, path: str | Mapping[str, Any] | list, select: Any = None) -> "Query":
        specs = [path] if isinstance(path, (str, Mapping)) else path
        new = [{"path": p, "select": select} if isinstance(x, str) else dict(x) for x in specs for p in (x.split() if isinstance(x, str) else [x])]
        return self._with(_populate=[*self._populate, *new])

    def get_populated_paths(self) -> list[str]:
        return [x["path"] for x in self._populate]

    def lean(self, on: bool = True) -> "Query":
        return self._with(_lean=on)

    def transform(self, f: Callable) -> "Query":
        """f maps the list of results."""
        return self._with(_transforms=[*self._transforms, f])

    def or_fail(self, error: Exception | None = None) -> "Query":
        return self._with(_or_fail=error or LookupError("no document found"))

    def hint(self, *hints: Any) -> "Query":
        return self._with(_hint=hints)

    def __getattr__(self, key: str) -> Any:
        if key in IGNORED:
            return lambda *args: self._with(_options={**self._options, key: args[0] if len(args) == 1 else args or True})
        statics = getattr(self.__dict__.get("_model"), "query_helpers", None) or {}
        if key in statics:
            return lambda *args, **kw: statics[key](self, *args, **kw)
        raise AttributeError(key)

    # Introspection and combination.
    def get_filter(self) -> dict[str, Any]:
        return {} if not self._conditions else dict(self._conditions[0]) if len(self._conditions) == 1 else {"$and": [dict(c) for c in self._conditions]}

    get_query = get_filter

    def set_query(self, conditions: Mapping[str, Any]) -> "Query":
        return self._with(_conditions=[dict(conditions)])

    def get_options(self) -> dict[str, Any]:
        return {**self._options, "sort": dict(self._order), "skip": self._skip, "limit": self._limit, "lean": self._lean}

    def set_options(self, options: Mapping[str, Any]) -> "Query":
        out = self
        for k, v in options.items():
            out = getattr(out, k)(v) if k in ("sort", "skip", "limit", "lean", "select", "populate") else out._with(_options={**out._options, k: v})
        return out

    def get_update(self) -> Mapping[str, Any] | None:
        return self._update

    def set_update(self, update: Mapping[str, Any]) -> "Query":
        return self._with(_update=dict(update))

    def set(self, path: str | Mapping[str, Any], value: Any = None) -> "Query":
        new = dict(path) if isinstance(path, Mapping) else {path: value}
        held = dict(self._update or {})
        return self._with(_update={**held, "$set": {**held.get("$set", {}), **new}})

    def get(self, path: str) -> Any:
        return next((c[path] for c in reversed(self._conditions) if path in c), None)

    def clone(self) -> "Query":
        return self._with()

    def merge(self, other: "Query | Mapping[str, Any]") -> "Query":
        if isinstance(other, Mapping):
            return self._add(other)
        return self._with(_conditions=[*self._conditions, *other._conditions], _fields={**self._fields, **other._fields}, _order={**self._order, **other._order})

    def to_constructor(self) -> Callable[..., "Query"]:
        return lambda conditions=None: self.find(conditions)

    # Execution.
    def matched(self) -> DataFrame:
        df = self._source()
        condition = self.get_filter()
        text = getattr(self._model, "text_fields", None)
        return df.where(compile_filter(condition, Scope(df, text))) if condition else df

    def df(self) -> DataFrame:
        """Filter, order, skip, limit, virtual fields, populated references, fields; one plan."""
        hooks = self._model.hooks if self._model is not None else None
        query = hooks("pre", "find", self) if hooks else self
        df = query._plan()
        return hooks("post", "find", df) if hooks else df

    def _plan(self) -> DataFrame:
        df = self.matched()
        if self._hint:
            df = df.hint(*self._hint)
        scope = Scope(df, getattr(self._model, "text_fields", None))
        if self._random is not None:
            df = df.orderBy(F.rand(self._random))
        elif self._order:
            keys = [scope.path(k).asc_nulls_first() if way == 1 else scope.path(k).desc_nulls_last() for k, way in self._order.items()]
            if "_id" in df.columns and "_id" not in self._order:
                keys.append(name("_id").asc_nulls_first())
            df = df.orderBy(*keys)
        elif self._nearest:
            path, point = self._nearest
            df = df.orderBy(metres_between(scope.path(path), *point), *([name("_id")] if "_id" in df.columns else []))
        if self._skip:
            df = df.offset(self._skip)
        if self._limit:
            df = df.limit(self._limit)
        for field, query in self._scores.items():
            texts = [F.lower(name(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
            hits = [F.coalesce(c.contains(word.lower()).cast("int"), F.lit(0)) for word in query.split() for c in texts]
            df = df.withColumn(field, sum(hits, F.lit(0)))
        for path, spec in self._slices.items():
            if isinstance(spec, int):
                spec = [0, spec] if spec >= 0 else [spec, -spec]
            start = F.lit(spec[0] + 1) if spec[0] >= 0 else F.greatest(F.size(name(path)) + spec[0] + 1, F.lit(1))
            df = df.withColumn(path, F.slice(name(path), start, spec[1]))
        if self._model is not None and self._model.schema is not None:
            df = self._model.schema.with_virtuals(df)
        if self._populate:
            scope, order = Scope(df), self._order
            df = df.withColumns({f"_order{i}": scope.path(k) for i, k in enumerate(order)}) if order else df
            for spec in self._populate:
                df = self._model.populated(df, spec)
            # Joins lose the order.
            if order:
                keys = [F.col(f"_order{i}").asc_nulls_first() if way == 1 else F.col(f"_order{i}").desc_nulls_last() for i, way in enumerate(order.values())]
                df = df.orderBy(*keys, name("_id").asc_nulls_first()).drop(*(f"_order{i}" for i in range(len(order))))
        return self._narrow(df)

    def _narrow(self, df: DataFrame) -> DataFrame:
        if not self._fields:
            return df
        scope = Scope(df)
        if self.selected_exclusively():
            dropped = [k for k, v in self._fields.items() if not v]
            for path in dropped:
                top, _, rest = path.partition(".")
                df = df.drop(path) if path in df.columns or not rest else df.withColumn(top, name(top).dropFields(rest))
            return df
        keep = {k: scope.path(k) for k, v in self._fields.items() if v}
        if "_id" in df.columns and self._fields.get("_id", 1):
            keep = {"_id": name("_id"), **keep}
        return df.select(*(c.alias(k) for k, c in keep.items()))

    def collect(self) -> list:
        """Documents, or rows as dicts with lean."""
        rows = [r.asDict(recursive=True) for r in self.df().collect()]
        if self._or_fail is not None and not rows:
            raise self._or_fail
        out: list = rows if self._lean or self._model is None else [self._model.hydrate(r) for r in rows]
        for f in self._transforms:
            out = f(out)
        return out

    exec = collect

    def one(self) -> Any:
        found = self.limit(1).collect()
        return found[0] if found else None

    find_one = one

    def __iter__(self) -> Iterator:
        for r in self.df().toLocalIterator():
            row = r.asDict(recursive=True)
            yield row if self._lean or self._model is None else self._model.hydrate(row)

    def cursor(self) -> Iterator:
        raise NotImplementedError("cursors are not supported; iterate over the query")

    def count_documents(self) -> int:
        return self.matched().count()

    def estimated_document_count(self) -> int:
        return self._source().count()

    def distinct(self, path: str) -> DataFrame:
        df = self.matched()
        return df.select(Scope(df).path(path).alias(path)).distinct()

    def explain(self, mode: str = "formatted") -> None:
        self.df().explain(mode)

    # Writes through the model.
    def _writes(self) -> Any:
        if self._model is None:
            raise NotImplementedError("this query has no collection to write to")
        return self._model

    def update_one(self, update: Mapping[str, Any] | None = None, **options: Any) -> Any:
        return self._writes().update_one(self.get_filter(), update or self._update, **options)

    def update_many(self, update: Mapping[str, Any] | None = None, **options: Any) -> Any:
        return self._writes().update_many(self.get_filter(), update or self._update, **options)

    def replace_one(self, doc: Mapping[str, Any], **options: Any) -> Any:
        return self._writes().replace_one(self.get_filter(), doc, **options)

    def delete_one(self) -> int:
        return self._writes().delete_one(self.get_filter())

    def delete_many(self) -> int:
        return self._writes().delete_many(self.get_filter())

    def find_one_and_update(self, update: Mapping[str, Any] | None = None, **options: Any) -> Any:
        return self._writes().find_one_and_update(self.get_filter(), update or self._update, **options)

    def find_one_and_replace(self, doc: Mapping[str, Any], **options: Any) -> Any:
        return self._writes().find_one_and_replace(self.get_filter(), doc, **options)

    def find_one_and_delete(self) -> Any:
        return self._writes().find_one_and_delete(self.get_filter())


def populated(df: DataFrame, path: str, foreign: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """References (or arrays of them) replaced by the documents they name: left joins on `_id`.

    A single reference that names nothing becomes a document with that _id alone; in arrays such references drop out.
    """
    if fields:
        foreign = foreign.select(*dict.fromkeys(["_id", *fields]))
    doc = F.struct(*(name(c) for c in foreign.columns))
    kind, fid = df.schema[path].dataType, foreign.schema["_id"].dataType
    listed = isinstance(kind, T.ArrayType)
    own = kind.elementType if listed else kind
    right = foreign.select(join_key(name("_id"), fid, own).alias("_fk"), doc.alias("_doc"))
    if not listed:
        bare = F.struct(*((name("_lk").cast(fid) if c == "_id" else F.lit(None).cast(foreign.schema[c].dataType)).alias(c) for c in foreign.columns))
        out = df.withColumn("_lk", join_key(name(path), kind, fid)).join(right, F.col("_lk") == F.col("_fk"), "left")
        return out.withColumn(path, F.coalesce("_doc", F.when(F.col("_lk").isNotNull(), bare))).drop("_lk", "_fk", "_doc")
    # A list's documents depend on the list alone; so rows that share an _id, or have none, can't be confused.
    each = df.select(name(path).alias("_row")).where("size(_row) > 0").distinct().select("_row", F.posexplode("_row").alias("_at", "_ref"))
    each = each.withColumn("_lk", join_key(F.col("_ref"), own, fid)).join(right, F.col("_lk") == F.col("_fk"))
    lists = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("_doc")))), lambda x: x["_doc"]).alias("_docs"))
    empty = F.array().cast(T.ArrayType(right.schema["_doc"].dataType))
    out = df.join(lists, name(path) == F.col("_row"), "left")
    held: Column = F.when(name(path).isNotNull(), F.coalesce("_docs", empty))
    return out.withColumn(path, held).drop("_row", "_docs")
