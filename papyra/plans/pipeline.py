"""Pipelines: lists of one-key stages, compiled to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paths import Scope
from papyra.operators import relational as r
from papyra.operators import series as s

STAGES: dict[str, Callable[[DataFrame, Any, "Context"], DataFrame]] = {
    "$match": r.match, "$project": r.project, "$addFields": r.add_fields, "$set": r.add_fields, "$unset": r.unset, "$replaceRoot": r.replace_root,
    "$group": r.group, "$sort": r.sort, "$limit": r.limit, "$skip": r.skip, "$unwind": r.unwind, "$lookup": r.lookup, "$unionWith": r.union_with,
    "$count": r.count, "$sortByCount": r.sort_by_count, "$facet": r.facet, "$bucket": r.bucket, "$bucketAuto": r.bucket_auto, "$sample": r.sample,
    "$redact": r.redact, "$search": r.search, "$geoNear": r.geo_near, "$documents": r.documents, "$changeStream": r.change_stream, "$out": r.out,
    "$merge": r.merge, "$graphLookup": s.graph_lookup, "$densify": s.densify, "$fill": s.fill, "$setWindowFields": s.set_window_fields,
}
#: Stages that keep the order of a $sort before them.
_ORDERLY = {"$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$unwind", "$limit", "$skip", "$sort", "$redact", "$search", "$changeStream"}
#: Stages that keep all rows but not their order; it is made again.
_DEALT = {"$lookup", "$graphLookup", "$setWindowFields"}
#: Stages that use the order and end it.
_LAST = {"$group", "$bucket", "$bucketAuto", "$facet", "$fill", "$merge"}


class Context:
    """What stages need besides their input: other collections, by name, and a way to write one."""

    def __init__(self, spark: SparkSession, collections: Callable[[str], DataFrame | None] | Mapping[str, DataFrame] | None = None, write: Callable[[str, DataFrame], None] | None = None, text_fields: list[str] | None = None):
        self.spark = spark
        self._find = collections if callable(collections) else (collections or {}).get
        self._write = write
        self.text_fields = text_fields
        self.order: list[tuple[str, int]] | None = None

    def collection(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        found = self._find(name)
        if found is None:
            if schema is None:
                raise KeyError(f"no collection {name}")
            return self.spark.createDataFrame([], schema)
        return found

    def write(self, name: str, df: DataFrame) -> None:
        if self._write is None:
            raise ValueError(f"nowhere to write {name}: the pipeline runs outside a database")
        self._write(name, df)

    def scope(self, df: DataFrame) -> Scope:
        texts = self.text_fields
        if texts is None and r.carried(df):  # hidden copies of text aren't searched
            texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith(r.HIDDEN)]
        return Scope(df, texts)

    def run(self, df: DataFrame, pipeline: Iterable[Mapping[str, Any]]) -> DataFrame:
        return compile_pipeline(df, pipeline, Context(self.spark, self._find, self._write, self.text_fields))

    def run_ordered(self, df: DataFrame, pipeline: Iterable[Mapping[str, Any]]) -> tuple[DataFrame, list[tuple[str, int]] | None]:
        """A sub-pipeline that starts in this one's order: its rows with their hidden columns, and their order."""
        inner = Context(self.spark, self._find, self._write, self.text_fields)
        inner.order = self.order
        return _compile(df, pipeline, inner), inner.order


def check(pipeline: Iterable[Mapping[str, Any]]) -> list[tuple[str, Any]]:
    out = []
    for stage in pipeline:
        if len(stage) != 1:
            raise ValueError(f"a stage has one key: {sorted(stage)}")
        ((op, spec),) = stage.items()
        if op not in STAGES:
            raise ValueError(f"unknown stage {op}")
        out.append((op, spec))
    return out


def _summary(lookup: Mapping, project: Mapping) -> tuple[dict[str, str | None], dict] | None:
    """For a $project after a $lookup that uses its array only in $size and $sum of a field: hidden column -> field (None:
    the size), and the project with those columns instead."""
    array, wanted = "$" + lookup["as"], {}

    def swap(x: Any) -> Any:
        if isinstance(x, Mapping) and len(x) == 1:
            ((op, arg),) = x.items()
            if x == {"$size": array} or (op == "$sum" and isinstance(arg, str) and arg.startswith(array + ".")):
                key = f"_sum{len(wanted)}"
                wanted[key] = None if op == "$size" else arg[len(array) + 1 :]
                return "$" + key
        if isinstance(x, Mapping):
            return {k: swap(v) for k, v in x.items()}
        return [swap(v) for v in x] if isinstance(x, (list, tuple)) else x

    swapped = {k: swap(v) for k, v in project.items()}
    if not wanted or array in repr(swapped) or any(k.split(".")[0] == lookup["as"] for k in project):
        return None
    return wanted, swapped


def _in_order(df: DataFrame, ctx: Context, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage that joins or deals rows anew, and the order of a $sort before it again after it."""
    out = stage(df)
    return out.orderBy(*r.directed(ctx.order)) if ctx.order else out


def _presence(condition: Any, array: str) -> bool | None:
    """Whether a $match only asks for a looked-up array with elements (True) or without (False); None: something else."""
    if not isinstance(condition, Mapping) or len(condition) != 1:
        return None
    ((path, rule),) = condition.items()
    if path == array and rule in ({"$size": 0}, {"$eq": []}, []):
        return False
    if path == array and rule in ({"$ne": []}, {"$not": {"$size": 0}}):
        return True
    if path == f"{array}.0" and isinstance(rule, Mapping) and set(rule) == {"$exists"}:
        return bool(rule["$exists"])
    if path == "$expr" and isinstance(rule, Mapping) and len(rule) == 1:
        ((op, sides),) = rule.items()
        if isinstance(sides, (list, tuple)) and list(sides) == [{"$size": "$" + array}, 0]:
            return {"$eq": False, "$gt": True, "$ne": True}.get(op)
    return None


def _unread(stages: list[tuple[str, Any]], array: str) -> bool:
    """Whether the field is gone, or made anew, before any of the stages reads it."""
    for op, spec in stages:
        if op == "$unset" and array in ([spec] if isinstance(spec, str) else spec):
            return True
        if array in repr(spec):
            return False
        if op in ("$group", "$count", "$sortByCount", "$bucket", "$documents") or (op == "$project" and any(v not in (0, False) or isinstance(v, str) for v in spec.values())):
            return True
    return False


def _compile(df: DataFrame, pipeline: Iterable[Mapping[str, Any]], ctx: Context) -> DataFrame:
    stages = check(pipeline)
    i = 0
    while i < len(stages):
        op, spec = stages[i]
        following = stages[i + 1] if i + 1 < len(stages) else (None, None)
        if op == "$lookup" and following[0] == "$unwind":
            options = {"path": following[1]} if isinstance(following[1], str) else following[1]
            if options["path"].removeprefix("$") == spec["as"] and not options.get("includeArrayIndex"):
                keep = bool(options.get("preserveNullAndEmptyArrays"))
                df = _in_order(df, ctx, lambda d: r.lookup_unwind(d, spec, ctx, keep))
                i += 2
                continue
        if op == "$lookup" and following[0] == "$match" and (found := _presence(following[1], spec["as"])) is not None and (not found or _unread(stages[i + 2 :], spec["as"])):
            df = _in_order(df, ctx, lambda d: r.lookup_kept(d, spec, found, ctx))
            i += 2
            continue
        if op == "$lookup" and following[0] == "$project" and (found := _summary(spec, following[1])):
            df = _in_order(df, ctx, lambda d: r.lookup_summary(d, spec, found[0], ctx))
            df = r.project(df, found[1], ctx)
            i += 2
            continue
        if op in _DEALT:
            df = _in_order(df, ctx, lambda d: STAGES[op](d, spec, ctx))
        else:
            if op not in _ORDERLY and op not in _LAST:
                df, ctx.order = df.drop(*r.carried(df)), None
            df = STAGES[op](df, spec, ctx)
            if op not in _ORDERLY:
                df, ctx.order = df.drop(*r.carried(df)), None
        i += 1
    return df


def compile_pipeline(df: DataFrame, pipeline: Iterable[Mapping[str, Any]], ctx: Context) -> DataFrame:
    out = _compile(df, pipeline, ctx)
    return out.drop(*r.carried(out))


def aggregate(df: DataFrame, pipeline: Iterable[Mapping[str, Any]], collections: Any = None, write: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Run a pipeline on a DataFrame; collections maps names to DataFrames for stages that read others."""
    return compile_pipeline(df, pipeline, Context(df.sparkSession, collections, write))


_BUILT = {
    "match": "$match", "group": "$group", "sort": "$sort", "limit": "$limit", "skip": "$skip", "unwind": "$unwind", "project": "$project", "lookup": "$lookup",
    "add_fields": "$addFields", "densify": "$densify", "facet": "$facet", "graph_lookup": "$graphLookup", "union_with": "$unionWith", "sort_by_count": "$sortByCount",
    "count": "$count", "out": "$out", "merge": "$merge", "replace_root": "$replaceRoot", "set": "$set", "unset": "$unset", "bucket": "$bucket",
    "bucket_auto": "$bucketAuto", "change_stream": "$changeStream", "documents": "$documents", "fill": "$fill", "sample": "$sample",
    "set_window_fields": "$setWindowFields", "redact": "$redact", "search": "$search",
}


class Pipeline:
    """An immutable fluent builder: Pipeline(df).match({...}).group({...}).run()."""

    def __init__(self, df: DataFrame, ctx: Context, stages: tuple = (), options: Mapping | None = None):
        self._df, self._ctx, self.stages, self.options = df, ctx, tuple(stages), dict(options or {})
        check(self.stages)

    def append(self, *stages: Mapping) -> "Pipeline":
        return Pipeline(self._df, self._ctx, (*self.stages, *stages), self.options)

    def near(self, spec: Mapping) -> "Pipeline":
        return Pipeline(self._df, self._ctx, ({"$geoNear": spec}, *self.stages), self.options)

    def option(self, **values: Any) -> "Pipeline":
        """allow_disk_use, collation, comment, hint, read, session, ...: kept, without an effect on the plan."""
        return Pipeline(self._df, self._ctx, self.stages, {**self.options, **values})

    def __getattr__(self, method: str) -> Callable[..., "Pipeline"]:
        if method not in _BUILT:
            raise AttributeError(method)
        return lambda spec=None: self.append({_BUILT[method]: spec})

    def pipeline(self) -> list:
        return list(self.stages)

    def run(self) -> DataFrame:
        self._ctx.order = None
        return compile_pipeline(self._df, self.stages, self._ctx)

    def explain(self, mode: str = "formatted") -> None:
        self.run().explain(mode)

    def exec(self) -> list:
        return self.run().collect()
