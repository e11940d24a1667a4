"""Stages over graphs, series and windows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from papyra.functions.accumulators import compile_accumulator
from papyra.functions.expressions import compile_expr
from papyra.functions.filters import compile_filter
from papyra.functions.paths import name, resolve
from papyra.operators.relational import join_key, placed
from papyra.session import checkpoint

#: Grid points of $densify that one row makes; longer grids are made of several, by several tasks.
GRID = 100_000
#: Each unit as an interval, and the least seconds that it lasts (a day may have 23 hours).
_UNITS = {
    "second": ("1 SECOND", 1), "minute": ("1 MINUTE", 60), "hour": ("1 HOUR", 3600), "day": ("1 DAY", 82800), "week": ("7 DAY", 7 * 82800),
    "month": ("1 MONTH", 28 * 82800), "quarter": ("3 MONTH", 84 * 82800), "year": ("1 YEAR", 365 * 82800),
}


def graph_lookup(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """All documents of `from` reachable from startWith, as an array ordered by depth and _id.

    Each round joins the frontier (root key, value, depth) with the foreign rows whose connectToField is the value and
    goes on from their connectFromField; pairs of root and document that were met before drop out, so cycles end.
    Roots with equal start values share their search.
    """
    other = ctx.collection(spec["from"])
    if spec.get("restrictSearchWithMatch"):
        other = other.where(compile_filter(spec["restrictSearchWithMatch"], ctx.scope(other)))
    start = spec["startWith"]
    start = compile_expr(start if not isinstance(start, str) or start.startswith("$") else "$" + start, ctx.scope(df))
    kind = ctx.scope(df).type_of(start)
    to, to_kind = resolve(spec["connectToField"], other.schema)
    source, source_kind = resolve(spec["connectFromField"], other.schema)
    listed = isinstance(source_kind, T.ArrayType)
    inner = source_kind.elementType if listed else source_kind
    doc = F.struct(*(name(c) for c in other.columns))
    edges = checkpoint(other.select(join_key(to, to_kind, inner).alias("_to"), source.alias("_next"), doc.alias("_doc")).withColumn("_key", F.xxhash64("_doc")))
    starts = F.explode(start) if isinstance(kind, T.ArrayType) else start
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    frontier = df.select(start.alias("_root"), starts.alias("_at")).distinct()
    frontier = frontier.select("_root", join_key(F.col("_at"), element, to_kind).alias("_at")).where("_at is not null")
    found, depth = None, 0
    deepest = spec.get("maxDepth")
    while deepest is None or depth <= deepest:
        met = frontier.join(edges, F.col("_at") == F.col("_to")).select("_root", "_key", "_doc", "_next").dropDuplicates(["_root", "_key"])
        if found is not None:
            met = met.join(found.select(F.col("_root").alias("_r"), F.col("_key").alias("_k")), F.col("_root").eqNullSafe(F.col("_r")) & (F.col("_key") == F.col("_k")), "left_anti")
        met = checkpoint(met.withColumn("_depth", F.lit(depth).cast("long")))
        if met.isEmpty():
            break
        found = met if found is None else found.unionByName(met)
        following = F.explode("_next") if listed else F.col("_next")
        frontier = met.select("_root", following.alias("_v")).select("_root", join_key(F.col("_v"), inner, to_kind).alias("_at")).where("_at is not null").distinct()
        depth += 1
    field = spec.get("depthField")
    shape = F.struct(*(F.col("_doc").getField(c).alias(c) for c in other.columns), *([F.col("_depth").alias(field)] if field else []))
    rank = F.col("_doc").getField("_id") if "_id" in other.columns else F.col("_key")
    empty = edges.select("_doc", F.lit(0).cast("long").alias("_depth")).select(shape.alias("x")).schema["x"].dataType
    if found is None:
        return df.withColumn(spec["as"], F.array().cast(T.ArrayType(empty)))
    lists = found.groupBy("_root").agg(F.transform(F.array_sort(F.collect_list(F.struct("_depth", rank.alias("_rank"), shape.alias("_shape")))), lambda x: x["_shape"]).alias("_found"))
    return df.withColumn("_start", start).join(lists, F.col("_start").eqNullSafe(F.col("_root")), "left").withColumn(spec["as"], F.coalesce("_found", F.array().cast(T.ArrayType(empty)))).drop("_start", "_root", "_found")


def densify(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """Adds a row (partition fields and `field`) at each grid point that has none; existing rows all stay.

    range: step, unit (for times), bounds: 'full' (of all rows), 'partition' (the default) or [low, high], inclusive.
    Points are low + i * step; a grid of any length is made in blocks of GRID points, which tasks share.
    """
    field, by = spec["field"], list(spec.get("partitionByFields", ()))
    step, unit, bounds = spec["range"]["step"], spec["range"].get("unit"), spec["range"].get("bounds", "partition")
    kind = df.schema[field].dataType
    if step <= 0:
        raise ValueError("step must be positive")
    i = F.col("_i")
    if unit:
        single = unit.rstrip("s")
        if single not in _UNITS:
            raise ValueError(f"unknown unit {unit}")
        length, seconds = _UNITS[single]
        at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        last, point = F.floor((at("_high") - at("_low")) / F.lit(int(step) * seconds * 1_000_000)), F.col("_low") + F.expr(f"INTERVAL {length}") * (i * F.lit(int(step)))
    else:
        last, point = F.floor((F.col("_high") - F.col("_low")) / F.lit(step)), F.col("_low") + i * F.lit(step)
    low, high = F.min(name(field)), F.max(name(field))
    keys = [name(c) for c in by]
    if isinstance(bounds, (list, tuple)):
        ends = (df.select(*keys).distinct() if by else ctx.spark.range(1).select()).select(*keys, F.lit(bounds[0]).cast(kind).alias("_low"), F.lit(bounds[1]).cast(kind).alias("_high"))
    elif bounds == "full" and by:
        ends = df.select(*keys).distinct().crossJoin(df.agg(low.alias("_low"), high.alias("_high")))  # one row
    elif bounds in ("full", "partition"):
        ends = df.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    else:
        raise ValueError(f"unknown bounds {bounds}")
    ends = ends.where("_low <= _high").select(*keys, "_low", "_high", last.cast("long").alias("_last"))
    blocks = ends.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / F.lit(GRID)))))
    # A number of partitions is given: blocks are small before they are unfolded, so they would be put together again.
    blocks = blocks.repartition(int(ctx.spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    start = F.col("_block") * GRID
    points = blocks.select(*keys, "_low", "_high", F.explode(F.sequence(start, F.least("_last", start + (GRID - 1)))).alias("_i"))
    grid = points.select(*keys, "_high", point.cast(kind).alias(field)).where(name(field) <= F.col("_high")).drop("_high")
    have = df.select(*keys, name(field)).distinct()
    on = None
    a, b = grid.alias("a"), have.alias("b")
    for c in [*by, field]:
        term = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        on = term if on is None else on & term
    return df.unionByName(a.join(b, on, "left_anti"), allowMissingColumns=True)


def fill(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """output: {field: 'linear' | 'locf' | {'method': ...} | {'value': ...}}, by sortBy within partitionByFields.

    linear interpolates by position over runs of nulls between two values; locf carries the last value forward. Without
    partitions no task sees all rows.
    """
    by = [name(c) for c in spec.get("partitionByFields", ())]
    if "partitionBy" in spec:
        by = [compile_expr(spec["partitionBy"], ctx.scope(df))]
    order = spec.get("sortBy") or dict(ctx.order or ())
    keys = [name(k).asc_nulls_first() if way == 1 else name(k).desc_nulls_last() for k, way in order.items()]
    methods = {}
    for field, how in spec["output"].items():
        methods[field] = how if isinstance(how, str) else how.get("method", how)
    if not keys and any(m in ("linear", "locf") for m in methods.values()):
        raise ValueError("$fill needs sortBy")
    ordered = {f: m for f, m in methods.items() if m in ("linear", "locf")}
    if ordered and not by:
        df = _filled(df, keys, ordered)
        methods = {f: m for f, m in methods.items() if f not in ordered}
    w = W.partitionBy(*by).orderBy(*keys) if keys else None
    values: dict[str, Column] = {}
    for field, how in methods.items():
        x = name(field)
        if how == "locf":
            values[field] = F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        elif how == "linear":
            at = F.row_number().over(w)
            back = W.partitionBy(*by).orderBy(F.desc("_at"))  # a frame that shrinks towards the end would be read anew for each row
            known = F.when(x.isNotNull(), F.struct(F.col("_at").alias("i"), x.cast("double").alias("v")))
            df = df.withColumn("_at", at).withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.last(known, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
            between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_at") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
            df = df.withColumn(field, F.coalesce(x.cast("double"), between)).drop("_at", "_a", "_b")
        elif isinstance(how, Mapping) and "value" in how:
            values[field] = F.coalesce(x, compile_expr(how["value"], ctx.scope(df)))
        else:
            raise ValueError(f"unknown fill method {how}")
    return df.withColumns(values) if values else df


def _filled(df: DataFrame, keys: list[Column], methods: Mapping[str, str]) -> DataFrame:
    """All rows as one series: each range of the order fills itself, and takes the last value of those before and the first
    of those after where it lacks one. A row for each range is all that meets in one task."""
    rows = placed(df, keys)
    ahead = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    known = {f: F.when(name(f).isNotNull(), F.struct(F.col("_at").alias("i"), name(f).alias("v"))) for f in methods}
    numbers = {f: (f"_first{j}", f"_last{j}") for j, f in enumerate(methods)}
    ends = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), *(pick(known[f], known[f]["i"]).alias(c) for f in methods for pick, c in zip((F.min_by, F.max_by), numbers[f], strict=True)))
    before, after = (W.orderBy(by).rowsBetween(W.unboundedPreceding, -1) for by in (F.col("_part"), F.desc("_part")))
    ends = ends.withColumn("_from", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    placed_at = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("_from")).alias("i"), F.col(f"{c}.v").alias("v")))
    ends = ends.withColumns({c: placed_at(c) for pair in numbers.values() for c in pair})
    near = {c: F.last(c, ignorenulls=True).over(w).alias(c) for first, last in numbers.values() for c, w in ((first, after), (last, before))}
    out = rows.join(F.broadcast(ends.select("_part", "_from", *near.values())), "_part").withColumn("_at", F.col("_at") + F.col("_from"))
    values = {}
    for f, how in methods.items():
        first, last = numbers[f]
        a, b = F.coalesce(F.last(known[f], ignorenulls=True).over(ahead), F.col(last)), F.coalesce(F.last(known[f], ignorenulls=True).over(back), F.col(first))
        if how == "locf":
            values[f] = a["v"]
        else:
            low, high = a["v"].cast("double"), b["v"].cast("double")
            values[f] = F.coalesce(name(f).cast("double"), low + (high - low) * (F.col("_at") - a["i"]) / (b["i"] - a["i"]))
    return out.withColumns(values).select(*(name(c) for c in df.columns))


_RANKS = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number, "$rowNumber": F.row_number}


def set_window_fields(df: DataFrame, spec: Mapping, ctx) -> DataFrame:
    """output: {name: {accumulator or $rank, $denseRank, $documentNumber, $ntile, $shift, $lag, $lead; window: {documents | range: [a, b]}}}."""
    scope = ctx.scope(df)
    by = spec.get("partitionBy")
    by = [] if by is None else [compile_expr(by if not isinstance(by, str) or by.startswith("$") else "$" + by, scope)]
    keys = [scope.path(k).asc_nulls_first() if way == 1 else scope.path(k).desc_nulls_last() for k, way in spec.get("sortBy", {}).items()]
    base = W.partitionBy(*by).orderBy(*keys) if keys else W.partitionBy(*by)
    return df.withColumns({out: _windowed({k: v for k, v in what.items() if k != "window"}, what.get("window"), base, bool(keys), scope) for out, what in spec["output"].items()})


def _windowed(what: Mapping, window: Mapping | None, base: Any, ordered: bool, scope) -> Column:
    ((op, arg),) = what.items()
    if op in _RANKS:
        return _RANKS[op]().over(base)
    if op == "$ntile":
        return F.ntile(arg).over(base)
    if op in ("$lag", "$lead", "$shift"):
        by = arg.get("by", 1)
        if op == "$shift":
            op, by = ("$lag", -by) if by < 0 else ("$lead", by)
        value = compile_expr(arg["output"], scope)
        default = arg.get("default")
        return (F.lag if op == "$lag" else F.lead)(value, by, default).over(base)
    kind, (low, high) = next(iter(window.items())) if window else ("documents", ("unbounded", "unbounded"))
    edge = lambda x, end: 0 if x == "current" else x if x != "unbounded" else end
    low, high = edge(low, W.unboundedPreceding), edge(high, W.unboundedFollowing)
    framed = base.rowsBetween(low, high) if kind == "documents" else base.rangeBetween(low, high)
    if op == "$first":
        return F.first(compile_expr(arg, scope), ignorenulls=True).over(framed)
    if op == "$last":
        return F.last(compile_expr(arg, scope)).over(framed)
    if op == "$push":
        return F.transform(F.collect_list(F.struct(compile_expr(arg, scope).alias("v"))).over(framed), lambda x: x["v"])
    if op == "$addToSet":
        return F.array_sort(F.collect_set(compile_expr(arg, scope)).over(framed))
    if op == "$sum" and not isinstance(arg, (int, float)):
        return F.coalesce(F.sum(compile_expr(arg, scope)).over(framed), F.lit(0))
    simple = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if op in simple:
        return simple[op](compile_expr(arg, scope)).over(framed)
    if op == "$count" or op == "$sum":
        return F.count(F.lit(1)).over(framed) * F.lit(arg if op == "$sum" else 1)
    return compile_accumulator(what, scope).over(framed)
