"""Pipeline stages over one or more collections: (df, spec, context) -> df."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from papyra.functions.accumulators import ascending, compile_accumulator, pushed
from papyra.functions.expressions import compile_expr, truthy
from papyra.functions.filters import compile_filter, text_search
from papyra.functions.geo import metres_between
from papyra.functions.paths import Scope, name, resolve
from papyra.session import checkpoint


#: Prefix of the hidden columns that carry the values of a $sort's keys, whatever later stages make of the fields.
HIDDEN = "__order"


def carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def match(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    return df.where(compile_filter(spec, ctx.scope(df)))


def _put(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set columns, all against the given df; a dotted name sets a field of a struct."""
    flat = {k: v for k, v in values.items() if "." not in k or k in df.columns}
    nested: dict[str, Column] = {}
    for k, v in values.items():
        if k not in flat:
            top, rest = k.split(".", 1)
            if top in df.columns and isinstance(df.schema[top].dataType, T.StructType):
                nested[top] = nested.get(top, name(top)).withField(rest, v)
            else:
                nested[top] = reduce(lambda inner, part: F.struct(inner.alias(part)), reversed(rest.split(".")), v)
    return df.withColumns({**flat, **nested})


def add_fields(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    scope = ctx.scope(df)
    return _put(df, {k: compile_expr(v, scope) for k, v in spec.items()})


def unset(df: DataFrame, spec: str | list, ctx) -> DataFrame:
    for path in [spec] if isinstance(spec, str) else spec:
        top, _, rest = path.partition(".")
        if path in df.columns:
            df = df.drop(path)
        elif rest and top in df.columns and isinstance(df.schema[top].dataType, T.StructType):
            df = df.withColumn(top, name(top).dropFields(rest))
    return df


def project(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """1 and true include, 0 and false exclude, anything else is an expression. Columns come in the spec's order."""
    if all(v in (0, False) and not isinstance(v, str) for v in spec.values()):
        return unset(df, list(spec), ctx)
    scope = ctx.scope(df)
    out = []
    for key, value in spec.items():
        if isinstance(value, (bool, int, float)):
            if value:
                column, kind = scope.typed(key)
                out.append(column.alias(key))
        else:
            out.append(compile_expr(value, scope).alias(key))
    return df.select(*out, *carried(df))


def replace_root(df: DataFrame, spec: Any, ctx) -> DataFrame:
    root = compile_expr(spec["newRoot"] if isinstance(spec, Mapping) and "newRoot" in spec else spec, ctx.scope(df))
    return df.select(root.alias("_root"), *carried(df)).where("_root is not null").select("_root.*", *carried(df))


def group(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    scope = ctx.scope(df)
    key = F.lit(None) if spec.get("_id") is None else compile_expr(spec["_id"], scope)
    parts = [compile_accumulator(v, scope, ctx.order).alias(k) for k, v in spec.items() if k != "_id"]
    grouped = df.groupBy(key.alias("_id"))
    return grouped.agg(*parts) if parts else grouped.agg(F.lit(1).alias("_one")).drop("_one")


def directed(order: list[tuple[str, int]]) -> list[Column]:
    """Nulls first upwards, last downwards."""
    return [name(k).asc_nulls_first() if way == 1 else name(k).desc_nulls_last() for k, way in order]


def sort(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """Nulls first upwards, last downwards; `_id`, where there is one, breaks ties. The keys' values go along, hidden."""
    df = df.drop(*carried(df))
    scope = ctx.scope(df)
    ways = dict(spec)
    if "_id" in df.columns and "_id" not in spec and not isinstance(df.schema["_id"].dataType, (T.MapType, T.VariantType)):
        ways["_id"] = 1
    ctx.order = [(f"{HIDDEN}{i}", way) for i, way in enumerate(ways.values())]
    return df.withColumns({h: scope.path(k) for (h, _), k in zip(ctx.order, ways, strict=True)}).orderBy(*directed(ctx.order))


def limit(df: DataFrame, spec: int, ctx) -> DataFrame:
    return df.limit(spec)


def skip(df: DataFrame, spec: int, ctx) -> DataFrame:
    return df.offset(spec)


def unwind(df: DataFrame, spec: str | Mapping, ctx) -> DataFrame:
    """A row per element; null and non-array values stay as they are, empty arrays drop their row (unless preserved)."""
    options = {"path": spec} if isinstance(spec, str) else spec
    path = options["path"].removeprefix("$")
    column, kind = ctx.scope(df).typed(path)
    index = options.get("includeArrayIndex")
    if not isinstance(kind, T.ArrayType):
        return df.withColumn(index, F.lit(None).cast("long")) if index else df
    empty = F.array(F.lit(None).cast(kind.elementType))
    values = F.coalesce(column, empty)
    if options.get("preserveNullAndEmptyArrays"):
        values = F.when(F.size(values) == 0, empty).otherwise(values)
    if index or ctx.order:
        rows = df.select("*", F.posexplode(values).alias("_at", "_item"))
        if index:
            rows = rows.withColumn(index, F.when(column.isNotNull(), F.col("_at").cast("long")))
        if ctx.order:  # elements of one document come in their own order
            ctx.order = [*ctx.order, (f"{HIDDEN}{len(carried(df))}", 1)]
            rows = rows.withColumn(ctx.order[-1][0], F.col("_at"))
        rows = rows.drop("_at")
    else:
        rows = df.select("*", F.explode(values).alias("_item"))
    return _put(rows, {path: F.col("_item")}).drop("_item")


def join_key(column: Column, kind: T.DataType, other: T.DataType) -> Column:
    """The column itself if both sides have one type, else its text, in which whole numbers have no fraction."""
    if kind == other:
        return column
    if isinstance(kind, (T.IntegralType, T.NullType)) and isinstance(other, (T.IntegralType, T.NullType)):
        return column.cast("long")
    if isinstance(kind, (T.FractionalType,)):
        return F.when(column == F.floor(column), F.floor(column).cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def lookup(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """Left join into an array. The foreign side is grouped by its key first, so that rows meet one row each."""
    foreign, on, local = _foreign(df, spec, ctx)
    return local.join(foreign.groupBy("_fk").agg(F.collect_list("_doc").alias("_found")), on, "left").withColumn(spec["as"], _or_empty(foreign)).drop("_lk", "_fk", "_found")


def _or_empty(foreign: DataFrame) -> Column:
    return F.coalesce(F.col("_found"), F.array().cast(T.ArrayType(foreign.schema["_doc"].dataType)))


def _foreign(df: DataFrame, spec: Mapping, ctx) -> tuple[DataFrame, Column, DataFrame]:
    other = ctx.collection(spec["from"])
    if spec.get("pipeline"):
        other = ctx.run(other, spec["pipeline"])
    fk, fkind = resolve(spec["foreignField"], other.schema)
    lk, lkind = resolve(spec["localField"], df.schema)
    foreign = other.select(join_key(fk, fkind, lkind).alias("_fk"), F.struct(*(name(c) for c in other.columns)).alias("_doc"))
    local = df.drop(spec["as"]) if spec["as"] in df.columns and spec["as"] != spec["localField"] else df
    local = local.withColumn("_lk", join_key(lk, lkind, fkind))
    return foreign, F.col("_lk").eqNullSafe(F.col("_fk")), local


def lookup_unwind(df: DataFrame, spec: Mapping, ctx, preserve: bool = False) -> DataFrame:
    """$lookup directly followed by $unwind of its array: a plain join, nothing is collected."""
    foreign, on, local = _foreign(df, spec, ctx)
    return local.join(foreign, on, "left" if preserve else "inner").withColumn(spec["as"], F.col("_doc")).drop("_lk", "_fk", "_doc")


def lookup_summary(df: DataFrame, spec: Mapping, wanted: dict[str, str | None], ctx) -> DataFrame:
    """$lookup of which only sizes (None) and sums of a field are used: aggregates instead of arrays, under names of wanted."""
    foreign, on, local = _foreign(df, spec, ctx)
    parts, defaults = [], {}
    for out, field in wanted.items():
        if field is None:
            parts.append(F.count(F.lit(1)).cast("int").alias(out))
            defaults[out] = F.coalesce(name(out), F.lit(0))
        else:
            column, kind = resolve("_doc." + field, foreign.schema)
            to = "long" if isinstance(kind, T.IntegralType) else "double"
            parts.append(F.sum(column.cast(to)).alias(out))
            defaults[out] = F.coalesce(name(out), F.lit(0).cast(to))
    return local.join(foreign.groupBy("_fk").agg(*parts), on, "left").withColumns(defaults).drop("_lk", "_fk")


def lookup_kept(df: DataFrame, spec: Mapping, found: bool, ctx) -> DataFrame:
    """$lookup followed by a $match that only asks whether its array has elements: a semi or anti join, nothing is collected.

    After an anti join the array is there and empty; after a semi join it isn't there (nothing later may read it).
    """
    foreign, on, local = _foreign(df, spec, ctx)
    if found:
        return local.join(foreign, on, "left_semi").drop("_lk")
    return local.join(foreign, on, "left_anti").withColumn(spec["as"], F.array().cast(T.ArrayType(foreign.schema["_doc"].dataType))).drop("_lk")


def union_with(df: DataFrame, spec: str | Mapping, ctx) -> DataFrame:
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = ctx.collection(spec.get("coll") or spec["collection"])
    if spec.get("pipeline"):
        other = ctx.run(other, spec["pipeline"])
    return df.unionByName(other, allowMissingColumns=True)


def count(df: DataFrame, spec: str, ctx) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(spec))


def sort_by_count(df: DataFrame, spec: Any, ctx) -> DataFrame:
    key = spec if not isinstance(spec, str) or spec.startswith("$") else "$" + spec
    return df.groupBy(compile_expr(key, ctx.scope(df)).alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col("_id").asc_nulls_first())


def facet(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """One row: each sub-pipeline's documents as an array, in the order that they have. Each part is a single row, so joining
    them multiplies nothing; each reads the columns that it needs, and starts in the order of a $sort before."""
    parts = []
    for key, pipeline in spec.items():
        part, order = ctx.run_ordered(df, pipeline)
        document = F.struct(*(name(c) for c in part.columns if not c.startswith(HIDDEN)))
        parts.append(part.agg(pushed(document, order, Scope(part)).alias(key)))
    return reduce(lambda a, b: a.crossJoin(b), parts)


def _grouped_output(df: DataFrame, key: Column, spec: Mapping, ctx) -> DataFrame:
    scope = ctx.scope(df)
    output = spec.get("output") or {"count": {"$sum": 1}}
    return df.groupBy(key.alias("_id")).agg(*(compile_accumulator(v, scope, ctx.order).alias(k) for k, v in output.items()))


def bucket(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """Lower bounds are inclusive; values outside all bounds go to `default`, or are dropped without one."""
    value, bounds = compile_expr(spec["groupBy"], ctx.scope(df)), list(spec["boundaries"])
    if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("boundaries must ascend and be two or more")
    has_default = spec.get("default") is not None
    text = has_default and isinstance(spec["default"], str) != isinstance(bounds[0], str)
    as_key = (lambda x: F.lit(str(x))) if text else F.lit
    key = F.lit(spec["default"]) if has_default else F.lit(None)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        key = F.when((value >= low) & (value < high), as_key(low)).otherwise(key)
    rows = df if has_default else df.where((value >= bounds[0]) & (value < bounds[-1]))
    return _grouped_output(rows, key, spec, ctx).orderBy("_id")


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt to tasks by ranges of the order (ties: by all values), sorted there, and written with _part, which numbers
    the ranges, and _at: 0, 1, ... in each. No task sorts everything, and places need no second shuffle."""
    order = [*order, *(name(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType)))]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return checkpoint(rows.withColumn("_part", F.shiftright("_place", 33)).withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place"))


def numbered(df: DataFrame, value: Column) -> DataFrame:
    """df with _rank: 0, 1, ... by value over all rows; the ranges' sizes (one number for each) are all that is collected."""
    dealt = placed(df.withColumn("_value", value), [F.col("_value").asc_nulls_first()])
    before, offsets = 0, {}
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        offsets[r._part], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in offsets.items() for x in kv)), F.col("_part")) if offsets else F.lit(0)
    return dealt.withColumn("_rank", F.col("_at") + offset).withColumn("_rows", F.lit(before).cast("long")).drop("_part", "_at")


def bucket_auto(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """Chunks of ceil(n / buckets) rows by value; _id holds the least and greatest value of each, both inclusive."""
    rows = numbered(df, compile_expr(spec["groupBy"], ctx.scope(df)))
    scope = ctx.scope(rows)
    output = spec.get("output") or {"count": {"$sum": 1}}
    chunk = F.floor(F.col("_rank") / F.ceil(F.col("_rows") / F.lit(spec["buckets"])))
    out = rows.groupBy(chunk.alias("_chunk")).agg(F.struct(F.min("_value").alias("min"), F.max("_value").alias("max")).alias("_id"), *(compile_accumulator(v, scope, ctx.order).alias(k) for k, v in output.items()))
    return out.orderBy("_chunk").drop("_chunk")


def sample(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    return df.orderBy(F.rand(spec.get("seed"))).limit(spec["size"])


def redact(df: DataFrame, spec: Any, ctx) -> DataFrame:
    """Keeps rows for which the condition comes to $$KEEP or $$DESCEND (or, for a plain condition, to true)."""
    names = {"$$KEEP": True, "$$DESCEND": True, "$$PRUNE": False, "KEEP": True, "DESCEND": True, "PRUNE": False}

    def swap(x: Any) -> Any:
        if isinstance(x, Mapping):
            return {k: swap(v) for k, v in x.items()}
        return [swap(v) for v in x] if isinstance(x, list) else names.get(x, x) if isinstance(x, str) else x

    if isinstance(spec, Mapping) and {"if", "then", "else"} <= set(spec):
        spec = {"$cond": dict(spec)}
    scope = ctx.scope(df)
    return df.where(truthy(compile_expr(swap(spec), scope), scope))


def search(df: DataFrame, spec: Any, ctx) -> DataFrame:
    text = spec.get("text", spec) if isinstance(spec, Mapping) else {"query": spec}
    query = text.get("query") or text.get("$search")
    scope = ctx.scope(df)
    if paths := text.get("path"):
        scope.text_fields = [paths] if isinstance(paths, str) else list(paths)
    return df.where(text_search(query, scope))


def geo_near(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    point = spec["near"]["coordinates"] if isinstance(spec["near"], Mapping) else spec["near"]
    away = metres_between(ctx.scope(df).path(spec.get("key", "location")), *point)
    out = df.withColumn(spec.get("distanceField", "distance"), away * spec.get("distanceMultiplier", 1))
    out = out.where(away.isNotNull())
    if spec.get("maxDistance") is not None:
        out = out.where(away <= spec["maxDistance"])
    if spec.get("minDistance") is not None:
        out = out.where(away >= spec["minDistance"])
    if spec.get("query"):
        out = match(out, spec["query"], ctx)
    keys = [F.col(spec.get("distanceField", "distance")), *([name("_id")] if "_id" in df.columns else [])]
    return out.orderBy(*keys)


def documents(df: DataFrame, spec: list, ctx) -> DataFrame:
    return ctx.spark.createDataFrame(spec) if spec else df.limit(0)


def change_stream(df: DataFrame, spec: Any, ctx) -> DataFrame:
    return df


def out(df: DataFrame, spec: str | Mapping, ctx) -> DataFrame:
    ctx.write(spec if isinstance(spec, str) else spec["coll"], df)
    return df


def merge(df: DataFrame, spec: str | Mapping, ctx) -> DataFrame:
    """Upsert into a collection by its `on` key. Matched rows: replace, merge, keepExisting (the default) or fail;
    others: insert (the default), discard or fail. Rows that share a key count as if they came one after the other."""
    spec = {"into": spec} if isinstance(spec, str) else spec
    on, matched, missing = spec.get("on", "_id"), spec.get("whenMatched", "keepExisting"), spec.get("whenNotMatched", "insert")
    bare = df.drop(*carried(df))
    ctx.write(spec["into"], merged(ctx.collection(spec["into"], bare.schema), df, on, matched, missing, ctx.order))
    return bare


def merged(old: DataFrame, new: DataFrame, on: str, matched: str = "keepExisting", missing: str = "insert", order: list[tuple[str, int]] | None = None) -> DataFrame:
    """old with new's rows. Of new rows that share a key the first stays if existing ones are kept, else the last one: by
    order, or by their values where there is none."""
    shown = [c for c in new.columns if not c.startswith(HIDDEN)]
    columns = list(dict.fromkeys([*old.columns, *shown]))
    a = old.select(F.struct(*(name(c) for c in old.columns)).alias("_old"), name(on).alias("_a"))
    key = ascending(order, Scope(new)) if order else None
    if key is None:
        key = F.struct(*(name(f.name) for f in new.schema.fields if f.name in shown and not isinstance(f.dataType, (T.MapType, T.VariantType))))
    pick = F.min_by if matched == "keepExisting" else F.max_by
    b = new.where(name(on).isNotNull()).groupBy(name(on).alias("_b")).agg(pick(F.struct(*(name(c) for c in shown)), key).alias("_new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full" if missing == "insert" else "left")
    new = new.select(*shown)
    hit, fresh = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_old").isNull()

    def side(alias: str, df: DataFrame, c: str) -> Column:
        return F.col(alias).getField(c) if c in df.columns else F.lit(None)

    def value(c: str) -> Column:
        x, y = side("_old", old, c), side("_new", new, c)
        when_hit = {"keepExisting": x, "replace": y, "merge": F.coalesce(y, x), "fail": F.raise_error(F.lit("a document matched"))}[matched]
        return F.when(hit, when_hit).when(fresh, y).otherwise(x).alias(c)

    return both.select(*(value(c) for c in columns))
