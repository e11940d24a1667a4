"""The driver's queries: one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.collection import Collection, Database
from papyra.functions.paths import Scope
from papyra.functions.updates import compile_update
from papyra.operators.relational import merged
from papyra.plans.pipeline import Pipeline, aggregate
from papyra.plans.query import Query, populated
from papyra.schema import Schema
from papyra.session import configure, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame(sql: str | None = None) -> Callable:
    """Registers a function (tables -> DataFrame), tables being a function from name to DataFrame."""

    def take(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(lambda t: read(spark, sf_dir, t))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def pipe(key: str, table: str, stages: list[Mapping[str, Any]], sql: str | None, others: tuple[str, ...] = (), source: Callable | None = None, **casts: str) -> None:
    """Registers a pipeline over a table; casts: final types of columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = source(lambda t: read(spark, sf_dir, t)) if source else read(spark, sf_dir, table)
        out = aggregate(df, stages, {t: read(spark, sf_dir, t) for t in others})
        return out.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else out

    QUERIES[key] = run
    if sql:
        SQL[key] = sql


def money(x: Any, n: int = 2) -> dict:
    return {"$round": [x, n]}


_REVENUE = {"$multiply": ["$l_extendedprice", {"$add": [1, {"$multiply": [-1, "$l_discount"]}]}]}
_ORDER = {"o_orderkey": 1, "o_totalprice": 1}

# Flagship.
pipe(
    "revenue_by_flag", "lineitem",
    [{"$match": {"l_quantity": {"$gt": 25}}}, {"$group": {"_id": "$l_returnflag", "revenue": {"$sum": _REVENUE}, "n": {"$sum": 1}}}, {"$addFields": {"revenue": money("$revenue")}}, {"$sort": {"revenue": -1}}, {"$limit": 2}],
    "select l_returnflag as _id, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_quantity > 25 group by 1 order by revenue desc limit 2",
)

# Filters.
pipe("match_eq", "orders", [{"$match": {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
pipe("match_range_and", "orders", [{"$match": {"o_totalprice": {"$gte": 100000, "$lt": 150000}, "$and": [{"o_orderstatus": {"$gt": "F"}}, {"o_orderpriority": {"$lte": "3-MEDIUM"}}]}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice < 150000 and o_orderstatus > 'F' and o_orderpriority <= '3-MEDIUM'")
pipe("match_ne_nin", "orders", [{"$match": {"o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where o_orderstatus <> 'F' and o_orderpriority not in ('1-URGENT', '5-LOW')")
pipe("match_in", "orders", [{"$match": {"o_orderpriority": {"$in": ["2-HIGH", "3-MEDIUM"]}}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM')")
pipe("match_or_nor", "orders", [{"$match": {"$or": [{"o_totalprice": {"$gt": 400000}}, {"o_orderstatus": "P"}], "$nor": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"$lt": 50000}}]}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where (o_totalprice > 400000 or o_orderstatus = 'P') and not (o_orderpriority = '1-URGENT' or o_totalprice < 50000)")
pipe("match_not", "part", [{"$match": {"p_size": {"$not": {"$gt": 10}}}}, {"$project": {"p_partkey": 1, "p_size": 1}}], "select p_partkey, p_size from part where not p_size > 10")
pipe("match_regex", "part", [{"$match": {"p_type": {"$regex": "^promo", "$options": "i"}, "p_name": {"$regex": "r[ei]"}}}, {"$project": {"p_partkey": 1, "p_name": 1}}], "select p_partkey, p_name from part where regexp_matches(p_type, '(?i)^promo') and regexp_matches(p_name, 'r[ei]')")
pipe("match_text_field", "documents", [{"$match": {"text": {"$text": "LICENSE"}}}, {"$project": {"doc_id": 1, "n_chars": 1}}], "select doc_id, n_chars from documents where contains(lower(text), 'license')")
pipe("match_text_search", "part", [{"$match": {"$text": {"$search": "brand#1"}}}, {"$project": {"p_partkey": 1, "p_brand": 1}}], "select p_partkey, p_brand from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1')")
pipe("match_mod", "events", [{"$match": {"event_id": {"$mod": [7, 3]}}}, {"$project": {"event_id": 1, "user_id": 1}}], "select event_id, user_id from events where event_id % 7 = 3")
pipe("match_exists", "events", [{"$addFields": {"large": {"$cond": [{"$gt": ["$value", 50]}, "$value", None]}}}, {"$match": {"large": {"$exists": False}, "user_id": {"$exists": True}}}, {"$project": {"event_id": 1}}], "select event_id from events where not value > 50")
pipe("match_missing_ne", "events", [{"$addFields": {"large": {"$cond": [{"$gt": ["$value", 50]}, "$event_type", None]}}}, {"$match": {"large": {"$ne": "click"}}}, {"$project": {"event_id": 1, "large": 1}}], "select event_id, case when value > 50 then event_type end as large from events where not (value > 50 and event_type = 'click')")
pipe("match_type", "events", [{"$match": {"value": {"$type": "number"}, "event_type": {"$type": "string"}, "ts": {"$type": "date"}}}, {"$count": "n"}], "select count(*) as n from events")
pipe("match_expr", "lineitem", [{"$match": {"$expr": {"$gt": ["$l_tax", "$l_discount"]}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}}}], "select l_returnflag as _id, count(*) as n from lineitem where l_tax > l_discount group by 1")
pipe("match_where", "part", [{"$match": {"$where": "p_size * 20 > p_retailprice"}}, {"$project": {"p_partkey": 1}}], "select p_partkey from part where p_size * 20 > p_retailprice")
pipe("match_json_schema", "orders", [{"$match": {"$jsonSchema": {"required": ["o_custkey"], "properties": {"o_orderstatus": {"enum": ["F", "O"]}, "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 200000}, "o_orderpriority": {"pattern": "^[123]"}}}}}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 200000 and regexp_matches(o_orderpriority, '^[123]')")

_LISTS = [{"$group": {"_id": "$o_custkey", "states": {"$push": "$o_orderstatus"}, "prices": {"$push": "$o_totalprice"}, "items": {"$push": {"status": "$o_orderstatus", "price": "$o_totalprice"}}}}]
_PER_CUSTOMER = "select o_custkey as _id, count(*) as n from orders group by o_custkey having "
pipe("match_all", "orders", [*_LISTS, {"$match": {"states": {"$all": ["F", "P"]}}}, {"$project": {"_id": 1, "n": {"$size": "$states"}}}], _PER_CUSTOMER + "list_has_all(list(o_orderstatus), ['F', 'P'])", n="bigint")
pipe("match_size", "orders", [*_LISTS, {"$match": {"states": {"$size": 12}}}, {"$project": {"_id": 1, "n": {"$size": "$states"}}}], _PER_CUSTOMER + "count(*) = 12", n="bigint")
pipe("match_elem", "orders", [*_LISTS, {"$match": {"items": {"$elemMatch": {"status": "P", "price": {"$gt": 450000}}}, "prices": {"$elemMatch": {"$lt": 20000}}}}, {"$project": {"_id": 1, "n": {"$size": "$states"}}}], _PER_CUSTOMER + "bool_or(o_orderstatus = 'P' and o_totalprice > 450000) and bool_or(o_totalprice < 20000)", n="bigint")
pipe("match_in_array", "orders", [*_LISTS, {"$match": {"states": {"$in": ["P"]}, "prices": {"$nin": [0.0]}}}, {"$project": {"_id": 1, "n": {"$size": "$states"}}}], _PER_CUSTOMER + "bool_or(o_orderstatus = 'P')", n="bigint")

# Shape.
pipe("project_include", "customer", [{"$project": {"c_name": 1, "c_custkey": 1, "c_acctbal": 0}}], "select c_name, c_custkey from customer")
pipe("project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "select c_custkey, c_nationkey, c_mktsegment from customer")
pipe("project_computed", "part", [{"$project": {"p_partkey": 1, "brand": "$p_brand", "total": money({"$multiply": ["$p_size", "$p_retailprice"]}), "big": {"$and": [{"$gt": ["$p_size", 20]}, {"$gt": ["$p_retailprice", 1000]}]}, "either": {"$or": [{"$eq": ["$p_type", "PROMO"]}, "$p_size"]}}}], "select p_partkey, p_brand as brand, round(p_size * p_retailprice, 2) as total, p_size > 20 and p_retailprice > 1000 as big, p_type = 'PROMO' or p_size <> 0 as either from part")
pipe("add_fields_swap", "customer", [{"$addFields": {"c_custkey": "$c_nationkey", "c_nationkey": "$c_custkey", "twice": {"$sum": ["$c_acctbal", "$c_acctbal"]}}}, {"$project": {"c_custkey": 1, "c_nationkey": 1, "twice": money("$twice")}}], "select c_nationkey as c_custkey, c_custkey as c_nationkey, round(c_acctbal * 2, 2) as twice from customer")
pipe("set_then_unset", "supplier", [{"$set": {"nested": {"key": "$s_suppkey", "bal": "$s_acctbal"}}}, {"$set": {"nested.extra": {"$add": ["$s_suppkey", 1]}}}, {"$unset": ["s_name", "nested.bal", "s_acctbal"]}, {"$project": {"s_nationkey": 1, "key": "$nested.key", "extra": "$nested.extra"}}], "select s_nationkey, s_suppkey as key, s_suppkey + 1 as extra from supplier")
pipe("replace_root", "orders", [{"$addFields": {"doc": {"key": "$o_orderkey", "price": "$o_totalprice"}}}, {"$replaceRoot": {"newRoot": "$doc"}}], "select o_orderkey as key, o_totalprice as price from orders")
pipe("unwind", "orders", [*_LISTS, {"$unwind": "$states"}, {"$group": {"_id": "$states", "n": {"$sum": 1}}}], "select o_orderstatus as _id, count(*) as n from orders group by 1")
pipe("unwind_keep_missing", "events", [{"$project": {"event_id": 1, "items": {"$cond": [{"$gt": ["$value", 10]}, ["$event_type", "all"], None]}}}, {"$unwind": "$items"}], "select event_id, unnest(case when value > 10 then [event_type, 'all'] else [null] end) as items from events")
pipe("sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 20}, {"$limit": 10}, {"$project": _ORDER}], "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
pipe("sort_by_count", "orders", [{"$sortByCount": "$o_orderpriority"}], "select o_orderpriority as _id, count(*) as count from orders group by 1")
pipe("count_stage", "lineitem", [{"$match": {"l_returnflag": "R"}}, {"$count": "n"}], "select count(*) as n from lineitem where l_returnflag = 'R'")
pipe("sample_stage", "orders", [{"$sample": {"size": 25, "seed": 7}}, {"$project": _ORDER}], None)
pipe("redact", "part", [{"$redact": {"if": {"$gt": ["$p_size", 25]}, "then": "$$KEEP", "else": "$$PRUNE"}}, {"$project": {"p_partkey": 1}}], "select p_partkey from part where p_size > 25")
pipe("search_stage", "part", [{"$search": {"text": {"query": "RED", "path": "p_name"}}}, {"$project": {"p_partkey": 1, "p_name": 1}}], "select p_partkey, p_name from part where contains(lower(p_name), 'red')")
pipe("documents_stage", "region", [{"$documents": [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]}], "select * from (values (1::bigint, 'a'), (2::bigint, 'b')) t(k, v)")
pipe("change_stream", "nation", [{"$changeStream": {}}], "select * from nation")
pipe("nested_json_path", "events", [{"$match": {"event_type": "click"}}, {"$project": {"event_id": 1, "k": "$p.k"}}], "select event_id, (props->>'k')::bigint as k from events where event_type = 'click'", source=lambda t: t("events").withColumn("p", F.from_json("props", "k bigint")))

# Groups.
pipe("group_stats", "lineitem", [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "avg": {"$avg": "$l_extendedprice"}, "low": {"$min": "$l_shipdate"}, "high": {"$max": "$l_tax"}, "n": {"$sum": 1}}}, {"$addFields": {"avg": money("$avg", 4)}}], "select l_returnflag as _id, sum(l_quantity) as qty, round(avg(l_extendedprice), 4) as avg, min(l_shipdate) as low, max(l_tax) as high, count(*) as n from lineitem group by 1")
pipe("group_null_id", "orders", [{"$group": {"_id": None, "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 2}}}, {"$project": {"total": money("$total"), "n": 1}}], "select round(sum(o_totalprice), 2) as total, count(*) * 2 as n from orders")
pipe("group_compound", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}, {"$project": {"flag": "$_id.flag", "status": "$_id.status", "n": 1}}], "select l_returnflag as flag, l_linestatus as status, count(*) as n from lineitem group by 1, 2")
pipe("group_year", "orders", [{"$group": {"_id": {"$year": "$o_orderdate"}, "n": {"$sum": 1}}}], "select year(o_orderdate)::bigint as _id, count(*) as n from orders group by 1", _id="bigint")
pipe("group_first_last", "orders", [{"$sort": {"o_orderdate": 1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "first": {"$first": "$o_orderkey"}, "last": {"$last": "$o_orderkey"}}}], "select o_custkey as _id, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) as first, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) as last from orders group by 1")
pipe("group_push_sorted", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "keys": {"$push": "$o_orderkey"}}}, {"$project": {"_id": 1, "top": {"$arrayElemAt": ["$keys", 0]}, "n": {"$size": "$keys"}, "total": {"$sum": "$keys"}}}], "select o_custkey as _id, arg_max(o_orderkey, {'p': o_totalprice, 'k': -o_orderkey}) as top, count(*) as n, sum(o_orderkey)::bigint as total from orders group by 1", n="bigint")
pipe("group_add_to_set", "orders", [{"$group": {"_id": "$o_custkey", "states": {"$addToSet": "$o_orderstatus"}}}, {"$project": {"_id": 1, "n": {"$size": "$states"}, "low": {"$arrayElemAt": ["$states", 0]}}}], "select o_custkey as _id, count(distinct o_orderstatus) as n, min(o_orderstatus) as low from orders group by 1", n="bigint")
pipe("group_stddev", "lineitem", [{"$group": {"_id": "$l_linestatus", "pop": {"$stdDevPop": "$l_quantity"}, "samp": {"$stdDevSamp": "$l_quantity"}}}, {"$addFields": {"pop": money("$pop", 6), "samp": money("$samp", 6)}}], "select l_linestatus as _id, round(stddev_pop(l_quantity), 6) as pop, round(stddev_samp(l_quantity), 6) as samp from lineitem group by 1")
pipe("group_merge_objects", "orders", [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "m": {"$mergeObjects": {"status": "$o_orderstatus", "price": {"$cond": [{"$gt": ["$o_totalprice", 100000]}, "$o_totalprice", None]}}}}}, {"$project": {"_id": 1, "status": "$m.status", "price": "$m.price"}}], "select o_custkey as _id, arg_max(o_orderstatus, o_orderkey) as status, arg_max(o_totalprice, o_orderkey) filter (where o_totalprice > 100000) as price from orders group by 1")
pipe("bucket", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 100000, 200000, 300000], "default": "other", "output": {"n": {"$sum": 1}, "high": {"$max": "$o_totalprice"}}}}], "select case when o_totalprice >= 0 and o_totalprice < 100000 then '0' when o_totalprice >= 100000 and o_totalprice < 200000 then '100000' when o_totalprice >= 200000 and o_totalprice < 300000 then '200000' else 'other' end as _id, count(*) as n, max(o_totalprice) as high from orders group by 1")
pipe("bucket_auto", "part", [{"$bucketAuto": {"groupBy": "$p_retailprice", "buckets": 7, "output": {"n": {"$sum": 1}, "keys": {"$sum": "$p_size"}}}}, {"$project": {"low": "$_id.min", "high": "$_id.max", "n": 1, "keys": 1}}], "with r as (select p_retailprice as v, p_size, (row_number() over (order by p_retailprice, p_partkey, p_name, p_brand, p_type, p_size) - 1) // ceil((select count(*) from part) / 7.0)::bigint as c from part) select min(v) as low, max(v) as high, count(*) as n, sum(p_size)::bigint as keys from r group by c")
pipe("facet", "orders", [{"$facet": {"by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}], "dear": [{"$match": {"o_totalprice": {"$gt": 490000}}}, {"$project": _ORDER}], "total": [{"$count": "n"}]}}, {"$project": {"states": {"$size": "$by_status"}, "rows": {"$sum": "$by_status.n"}, "dear": {"$size": "$dear"}, "total": {"$sum": "$total.n"}}}], "select count(distinct o_orderstatus) as states, count(*) as rows, count(*) filter (where o_totalprice > 490000) as dear, count(*) as total from orders", states="bigint", dear="bigint")
pipe("having", "orders", [{"$group": {"_id": "$o_custkey", "total": {"$sum": "$o_totalprice"}}}, {"$match": {"total": {"$gt": 4000000}}}, {"$project": {"_id": 1, "total": money("$total")}}], "select o_custkey as _id, round(sum(o_totalprice), 2) as total from orders group by 1 having sum(o_totalprice) > 4000000")

# Joins.
_ORDERS_OF = {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}
pipe("lookup_array", "nation", [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "people"}}, {"$match": {"people": {"$elemMatch": {"c_acctbal": {"$gt": 9000}}}}}, {"$project": {"n_name": 1, "n": {"$size": "$people"}, "bal": money({"$sum": "$people.c_acctbal"})}}], "select n_name, count(*) as n, round(sum(c_acctbal), 2) as bal from nation join customer on n_nationkey = c_nationkey group by n_nationkey, n_name having max(c_acctbal) > 9000", ("customer",), n="bigint")
pipe("lookup_size_sum", "customer", [{"$lookup": _ORDERS_OF}, {"$project": {"c_custkey": 1, "n": {"$size": "$orders"}, "total": money({"$sum": "$orders.o_totalprice"})}}], "select c_custkey, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on c_custkey = o_custkey group by 1", ("orders",), n="bigint")
pipe("lookup_unwind", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}, {"$lookup": _ORDERS_OF}, {"$unwind": "$orders"}, {"$project": {"c_custkey": 1, "key": "$orders.o_orderkey", "price": "$orders.o_totalprice"}}], "select c_custkey, o_orderkey as key, o_totalprice as price from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING'", ("orders",))
pipe("lookup_unwind_preserve", "customer", [{"$lookup": {**_ORDERS_OF, "pipeline": [{"$match": {"o_totalprice": {"$gt": 450000}}}]}}, {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}, {"$project": {"c_custkey": 1, "key": "$orders.o_orderkey"}}], "select c_custkey, o_orderkey as key from customer left join (select * from orders where o_totalprice > 450000) on c_custkey = o_custkey", ("orders",))
pipe("lookup_semi", "customer", [{"$lookup": {**_ORDERS_OF, "pipeline": [{"$match": {"o_orderstatus": "P"}}]}}, {"$match": {"orders": {"$not": {"$size": 0}}}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')", ("orders",))
pipe("lookup_anti", "customer", [{"$lookup": {**_ORDERS_OF, "pipeline": [{"$match": {"o_orderstatus": "P"}}]}}, {"$match": {"orders": {"$size": 0}}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')", ("orders",))
pipe("lookup_mixed_keys", "supplier", [{"$project": {"s_suppkey": 1, "key": {"$concat": [{"$toLower": "$k"}, ""]}}}, {"$lookup": {"from": "nation", "localField": "key", "foreignField": "n_nationkey", "as": "n"}}, {"$project": {"s_suppkey": 1, "n": {"$size": "$n"}}}], "select s_suppkey, (s_nationkey < 25)::bigint as n from supplier", ("nation",), source=lambda t: t("supplier").withColumn("k", F.col("s_nationkey").cast("string")), n="bigint")
pipe("union_with", "customer", [{"$project": {"key": "$c_custkey", "bal": "$c_acctbal"}}, {"$unionWith": {"coll": "supplier", "pipeline": [{"$match": {"s_acctbal": {"$gt": 0}}}, {"$project": {"key": "$s_suppkey", "bal": "$s_acctbal", "kind": {"$literal": "s"}}}]}}], "select c_custkey as key, c_acctbal as bal, null::varchar as kind from customer union all select s_suppkey, s_acctbal, 's' from supplier where s_acctbal > 0", ("supplier",))
pipe("union_with_plain", "region", [{"$unionWith": "region"}, {"$group": {"_id": "$r_name", "n": {"$sum": 1}}}], "select r_name as _id, 2::bigint as n from region", ("region",))


@frame("""with recursive e as (select n_nationkey as id, n_nationkey // 2 as parent from nation),
w as (select id as root, parent as node, 0 as depth from e union select w.root, e.parent, w.depth + 1 from w join e on e.id = w.node where w.depth < 10)
select root, count(distinct node) as n, sum(distinct node)::bigint as total from w group by root""")
def graph_lookup(t):
    nodes = t("nation").select(F.col("n_nationkey").cast("bigint").alias("_id"), F.floor(F.col("n_nationkey") / 2).cast("bigint").alias("parent"))
    found = aggregate(nodes, [{"$graphLookup": {"from": "nodes", "startWith": "$parent", "connectFromField": "parent", "connectToField": "_id", "as": "above", "depthField": "depth"}}], {"nodes": nodes})
    return found.select(F.col("_id").alias("root"), F.size("above").cast("bigint").alias("n"), F.expr("aggregate(above._id, 0L, (a, x) -> a + x)").alias("total"))


@frame("""select o_orderkey, c_name as customer, c_acctbal as bal from orders left join customer on o_custkey = c_custkey""")
def populate_single(t):
    people = t("customer").withColumnRenamed("c_custkey", "_id")
    return populated(t("orders"), "o_custkey", people, ["c_name", "c_acctbal"]).select("o_orderkey", F.col("o_custkey.c_name").alias("customer"), F.col("o_custkey.c_acctbal").alias("bal"))


def _parts_of_customers(t: Callable[[str], DataFrame], orders: DataFrame) -> DataFrame:
    rows = orders.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lists = aggregate(rows, [{"$group": {"_id": "$o_custkey", "parts": {"$addToSet": "$l_partkey"}}}])
    out = populated(lists, "parts", t("part").withColumnRenamed("p_partkey", "_id"), ["p_name"])
    return out.select("_id", F.array_join("parts.p_name", "|").alias("names"), F.size("parts").cast("bigint").alias("n"))


@frame("""select o_custkey as _id, string_agg(p_name, '|' order by k) as names, count(*) as n from (select distinct o_custkey, l_partkey as k from orders join lineitem on l_orderkey = o_orderkey) join part on p_partkey = k group by 1""")
def populate_array(t):
    return _parts_of_customers(t, t("orders"))


@frame("""select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v, a.w as w from (select c_custkey as k, c_acctbal as v, c_name as w from customer) a
full join (select case when s_suppkey % 4 = 0 then -1 - s_suppkey else s_suppkey end as k, s_acctbal as v from supplier) b on a.k = b.k""")
def merge_upsert(t):
    old = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("w"))
    # A quarter of the suppliers gets keys that no customer has, whatever the tables' sizes.
    key = F.when(F.col("s_suppkey") % 4 == 0, -1 - F.col("s_suppkey")).otherwise(F.col("s_suppkey"))
    return merged(old, t("supplier").select(key.alias("k"), F.col("s_acctbal").alias("v")), "k", "merge", "insert")


@frame("""select coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v from (select c_custkey as k, c_acctbal as v from customer) a
full join (select c_nationkey - 30 as k, min(c_acctbal) as v from customer group by 1) b on a.k = b.k""")
def merge_keep_insert(t):
    old = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return merged(old, t("customer").select((F.col("c_nationkey") - 30).cast("bigint").alias("k"), F.col("c_acctbal").alias("v")), "k", "keepExisting", "insert")


@frame("""select c_custkey as k, case when c_custkey in (select s_suppkey * 3 from supplier) then (select s_acctbal from supplier where s_suppkey * 3 = c_custkey) else c_acctbal end as v from customer""")
def merge_replace_discard(t):
    old = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return merged(old, t("supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("v")), "k", "replace", "discard")


# Windows and series.
pipe("window_running", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1, "o_orderkey": 1}, "output": {"running": {"$sum": "$o_totalprice", "window": {"documents": ["unbounded", "current"]}}, "nearby": {"$avg": "$o_totalprice", "window": {"documents": [-1, 1]}}, "rank": {"$rank": {}}, "number": {"$documentNumber": {}}}}}, {"$project": {"o_orderkey": 1, "running": money("$running"), "nearby": money("$nearby", 4), "rank": 1, "number": 1}}], "select o_orderkey, round(sum(o_totalprice) over (w rows unbounded preceding), 2) as running, round(avg(o_totalprice) over (w rows between 1 preceding and 1 following), 4) as nearby, rank() over w as rank, row_number() over w as number from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)", rank="bigint", number="bigint")
pipe("window_shift", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"before": {"$lag": {"output": "$o_totalprice"}}, "after": {"$shift": {"output": "$o_orderkey", "by": 1, "default": -1}}, "quarter": {"$ntile": 4}, "dense": {"$denseRank": {}}}}}, {"$project": {"o_orderkey": 1, "before": 1, "after": 1, "quarter": 1, "dense": 1}}], "select o_orderkey, lag(o_totalprice) over w as before, lead(o_orderkey, 1, -1) over w as after, ntile(4) over w as quarter, dense_rank() over w as dense from orders window w as (partition by o_custkey order by o_orderkey)", quarter="bigint", dense="bigint")
pipe("window_range", "part", [{"$setWindowFields": {"partitionBy": "$p_brand", "sortBy": {"p_size": 1}, "output": {"near": {"$sum": 1, "window": {"range": [-2, 2]}}, "top": {"$max": "$p_retailprice", "window": {"range": ["unbounded", "current"]}}}}}, {"$project": {"p_partkey": 1, "near": 1, "top": 1}}], "select p_partkey, count(*) over (w range between 2 preceding and 2 following) as near, max(p_retailprice) over (w range unbounded preceding) as top from part window w as (partition by p_brand order by p_size)")

_SPARSE = {"$addFields": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 4]}, 0]}, "$value", None]}}}
pipe("fill_locf", "events", [_SPARSE, {"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": "locf"}}}, {"$project": {"event_id": 1, "v": 1}}], "select event_id, last_value(case when event_id % 4 = 0 then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as v from events")
pipe("fill_linear", "events", [_SPARSE, {"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "linear"}}}}, {"$project": {"event_id": 1, "v": money("$v", 6)}}], """with s as (select event_id, user_id, case when event_id % 4 = 0 then value end as v, row_number() over (partition by user_id order by event_id) as i from events),
f as (select *, last_value(case when v is not null then i end ignore nulls) over (w rows unbounded preceding) as ai, last_value(v ignore nulls) over (w rows unbounded preceding) as av,
first_value(case when v is not null then i end ignore nulls) over (w rows between current row and unbounded following) as bi, first_value(v ignore nulls) over (w rows between current row and unbounded following) as bv from s window w as (partition by user_id order by event_id))
select event_id, round(coalesce(v, av + (bv - av) * (i - ai) / (bi - ai)), 6) as v from f""")
pipe("fill_all_rows", "events", [_SPARSE, {"$fill": {"sortBy": {"event_id": 1}, "output": {"v": "locf"}}}, {"$project": {"event_id": 1, "v": 1}}], "select event_id, last_value(case when event_id % 4 = 0 then value end ignore nulls) over (order by event_id rows unbounded preceding) as v from events")
pipe("fill_value", "events", [_SPARSE, {"$fill": {"output": {"v": {"value": 0.5}}}}, {"$project": {"event_id": 1, "v": 1}}], "select event_id, case when event_id % 4 = 0 then value else 0.5 end as v from events")
_HOURLY = [{"$group": {"_id": {"h": "$hour", "e": "$event_type"}, "n": {"$sum": 1}}}, {"$project": {"hour": "$_id.h", "kind": "$_id.e", "n": 1}}, {"$match": {"n": {"$gt": 3}}}]
_HOURS = "with h as (select date_trunc('hour', ts) as hour, event_type as kind, count(*) as n from events group by 1, 2 having count(*) > 3)"
pipe("densify_hours", "events", [*_HOURLY, {"$densify": {"field": "hour", "partitionByFields": ["kind"], "range": {"step": 1, "unit": "hours"}}}, {"$project": {"hour": 1, "kind": 1, "n": 1}}], _HOURS + ", g as (select kind, unnest(generate_series(min(hour), max(hour), interval 1 hour)) as hour from h group by kind) select g.hour, g.kind, h.n from g left join h using (kind, hour)", source=lambda t: t("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz")))
pipe("densify_days", "orders", [{"$group": {"_id": "$o_orderdate", "n": {"$sum": 1}}}, {"$match": {"n": {"$gt": 7}}}, {"$densify": {"field": "_id", "range": {"step": 1, "unit": "day", "bounds": "full"}}}], "with d as (select o_orderdate as _id, count(*) as n from orders group by 1 having count(*) > 7), g as (select unnest(generate_series(min(_id), max(_id), interval 1 day)) as _id from d) select g._id, d.n from g left join d using (_id)")
pipe("densify_numeric", "part", [{"$group": {"_id": "$p_size", "n": {"$sum": 1}}}, {"$match": {"_id": {"$mod": [3, 1]}}}, {"$densify": {"field": "_id", "range": {"step": 2, "bounds": [0, 60]}}}], "with d as (select p_size as _id, count(*) as n from part where p_size % 3 = 1 group by 1) select _id, n from d union all select x::int, null from generate_series(0, 60, 2) s(x) where x not in (select _id from d)")


# Areas: places derived from customer keys.
def _places(t: Callable) -> DataFrame:
    lon, lat = F.col("c_custkey") * 195 % 361 - 180, F.col("c_custkey") * 97 % 179 - 89
    return t("customer").select("c_custkey", F.array(lon.cast("double"), lat.cast("double")).alias("location"))


_LONLAT = "(select c_custkey, (c_custkey * 195 % 361 - 180)::double as x, (c_custkey * 97 % 179 - 89)::double as y from customer)"


def _metres(lon: float, lat: float) -> str:
    return f"2 * asin(sqrt(least(1, pow(sin(radians({lat} - y) / 2), 2) + cos(radians(y)) * cos(radians({lat})) * pow(sin(radians({lon} - x) / 2), 2))))"


pipe("geo_near", "customer", [{"$match": {"location": {"$near": {"$geometry": {"type": "Point", "coordinates": [10.0, 20.0]}, "$maxDistance": 2000000}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where {_metres(10.0, 20.0)} * 6371008.8 <= 2000000", source=_places)
pipe("geo_near_stage", "customer", [{"$geoNear": {"near": {"type": "Point", "coordinates": [-60.0, 5.0]}, "distanceField": "away", "maxDistance": 1500000, "key": "location"}}, {"$project": {"c_custkey": 1, "away": money("$away", 3)}}], f"select c_custkey, round({_metres(-60.0, 5.0)} * 6371008.8, 3) as away from {_LONLAT} where {_metres(-60.0, 5.0)} * 6371008.8 <= 1500000", source=_places)
pipe("geo_box", "customer", [{"$match": {"location": {"$geoWithin": {"$box": [[-20, -10], [30, 40]]}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where x between -20 and 30 and y between -10 and 40", source=_places)
pipe("geo_center", "customer", [{"$match": {"location": {"$geoWithin": {"$center": [[5, 5], 25.5]}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where sqrt(pow(x - 5, 2) + pow(y - 5, 2)) <= 25.5", source=_places)
pipe("geo_center_sphere", "customer", [{"$match": {"location": {"$geoWithin": {"$centerSphere": [[5.0, 45.0], 0.25]}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where {_metres(5.0, 45.0)} <= 0.25", source=_places)
pipe("geo_polygon", "customer", [{"$match": {"location": {"$geoWithin": {"$polygon": [[-50.5, -30.5], [60.5, -30.5], [60.5, 50.5]]}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where y > -30.5 and x < 60.5 and (x + 50.5) * 81 > (y + 30.5) * 111", source=_places)
pipe("geo_intersects", "customer", [{"$match": {"location": {"$geoIntersects": {"$geometry": {"type": "Polygon", "coordinates": [[[-40.5, -20.5], [40.5, -20.5], [40.5, 20.5], [-40.5, 20.5], [-40.5, -20.5]]]}}}}}, {"$project": {"c_custkey": 1}}], f"select c_custkey from {_LONLAT} where x > -40.5 and x < 40.5 and y > -20.5 and y < 20.5", source=_places)


# Expressions.
pipe("expr_arithmetic", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "a": {"$divide": [{"$subtract": ["$l_extendedprice", "$l_tax"]}, "$l_quantity"]}, "m": {"$mod": ["$l_partkey", 7]}, "n": {"$ifNull": [None, "$l_suppkey"]}}}], "select l_orderkey, l_linenumber, l_partkey, (l_extendedprice - l_tax) / l_quantity as a, l_partkey % 7 as m, l_suppkey as n from lineitem")
pipe("expr_text_dates", "orders", [{"$project": {"o_orderkey": 1, "t": {"$concat": [{"$toLower": "$o_orderpriority"}, "/", {"$toUpper": "$o_orderstatus"}]}, "y": {"$year": "$o_orderdate"}, "m": {"$month": "$o_orderdate"}, "d": {"$dayOfMonth": "$o_orderdate"}, "in": {"$in": ["$o_orderstatus", ["F", "P"]]}, "not": {"$not": ["$o_custkey"]}}}], "select o_orderkey, lower(o_orderpriority) || '/' || upper(o_orderstatus) as t, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, o_orderstatus in ('F', 'P') as \"in\", o_custkey = 0 as \"not\" from orders", y="bigint", m="bigint", d="bigint")
pipe("expr_compare", "part", [{"$project": {"p_partkey": 1, "c": {"$cond": {"if": {"$gte": ["$p_size", 25]}, "then": {"$literal": "big"}, "else": {"$literal": "small"}}}, "ne": {"$ne": ["$p_brand", "Brand#1"]}, "lt": {"$lt": ["$p_retailprice", 1000]}, "lte": {"$lte": ["$p_size", 5]}}}], "select p_partkey, case when p_size >= 25 then 'big' else 'small' end as c, p_brand <> 'Brand#1' as ne, p_retailprice < 1000 as lt, p_size <= 5 as lte from part")


# Updates, as the snapshot that they lead to.
def _updated(df: DataFrame, hit: str, update: Mapping[str, Any]) -> DataFrame:
    changes = compile_update(update, Scope(df))
    return df.withColumn("_hit", F.expr(hit)).withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, v in changes.items()}).drop("_hit")


@frame("""select o_orderkey, case when o_custkey < 500 then 'X' else o_orderstatus end as o_orderstatus, case when not o_custkey < 500 then o_orderpriority end as o_orderpriority,
case when not o_custkey < 500 then o_totalprice end as o_totalprice, case when o_custkey < 500 then o_totalprice end as price from orders""")
def update_set_unset_rename(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return _updated(df, "o_custkey < 500", {"$set": {"o_orderstatus": "X"}, "$unset": {"o_orderpriority": ""}, "$rename": {"o_totalprice": "price"}}).drop("o_custkey")


@frame("""select p_partkey, case when p_size > 20 then p_size + 5 else p_size end as p_size, round(case when p_size > 20 then p_retailprice * 1.5 else p_retailprice end, 4) as p_retailprice,
case when p_size > 20 then 2 end as fresh from part""")
def update_inc_mul(t):
    df = t("part").select("p_partkey", "p_size", "p_retailprice")
    out = _updated(df, "p_size > 20", {"$inc": {"p_size": 5, "fresh": 2}, "$mul": {"p_retailprice": 1.5}})
    return out.withColumn("p_retailprice", F.round("p_retailprice", 4))


@frame("""select c_custkey, least(c_acctbal, 5000.0) as c_acctbal, greatest(c_nationkey, 10) as c_nationkey, 7 as first from customer""")
def update_min_max(t):
    return _updated(t("customer").select("c_custkey", "c_acctbal", "c_nationkey"), "true", {"$min": {"c_acctbal": 5000.0}, "$max": {"c_nationkey": 10, "first": 7}})


@frame("""select s_suppkey, s_nationkey & 6 | 8 as s_nationkey, xor(s_suppkey, 5) as flipped from supplier""")
def update_bit(t):
    df = t("supplier").select("s_suppkey", "s_nationkey", F.col("s_suppkey").alias("flipped"))
    return _updated(df, "true", {"$bit": {"s_nationkey": {"and": 6, "or": 8}, "flipped": {"xor": 5}}})


@frame("""with a as (select o_custkey as _id, list(o_orderstatus order by o_orderkey) as l, list(o_orderkey order by o_orderkey) as k from orders group by 1)
select _id, array_to_string(list_append(l, 'Z'), '') as pushed, array_to_string(list_filter(l, lambda x: x <> 'F'), '') as pulled, array_to_string(list_filter(l, lambda x: x not in ('F', 'O')), '') as cleared,
array_to_string(l[:-2], '') as popped, array_to_string(case when list_contains(l, 'P') then l else list_append(l, 'P') end, '') as added, len(list_filter(k, lambda x: x < 5000)) as few from a""")
def update_arrays(t):
    df = aggregate(t("orders"), [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "pushed": {"$push": "$o_orderstatus"}, "few": {"$push": "$o_orderkey"}}}])
    df = df.withColumns({c: F.col("pushed") for c in ("pulled", "cleared", "popped", "added")})
    out = _updated(df, "true", {"$push": {"pushed": "Z"}, "$pull": {"pulled": "F", "few": {"$gte": 5000}}, "$pullAll": {"cleared": ["F", "O"]}, "$pop": {"popped": 1}, "$addToSet": {"added": "P"}})
    return out.select("_id", *(F.array_join(c, "").alias(c) for c in ("pushed", "pulled", "cleared", "popped", "added")), F.size("few").cast("bigint").alias("few"))


@frame("select r_regionkey, r_name, true as seen, true as ms from region")
def update_current_date(t):
    """All but the times, of which it only says that they are the present."""
    out = _updated(t("region"), "true", {"$currentDate": {"seen": True, "ms": {"$type": "timestamp"}}})
    recent = lambda seconds: F.abs(F.unix_timestamp(F.current_timestamp()) - seconds) < 60
    return out.withColumns({"seen": recent(F.unix_timestamp("seen")), "ms": recent(F.col("ms") / 1000)})


@frame("select 25::bigint as n, 25::bigint as different, 0::bigint as strangers, true as repeatable")
def sample_properties(t):
    """$sample: as many rows as asked for, none twice, all from the table, and the same ones for the same seed."""
    taken = lambda: aggregate(t("orders"), [{"$sample": {"size": 25, "seed": 7}}])
    found = taken().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("different"), F.sum("o_orderkey").alias("_a"))
    strangers = taken().join(t("orders"), taken().columns, "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    again = taken().agg(F.sum("o_orderkey").alias("_b"))
    return found.crossJoin(strangers).crossJoin(again).select("n", "different", "strangers", (F.col("_a") == F.col("_b")).alias("repeatable"))  # three rows of one


# Collections: written in a folder of their own under the shared one, and read back.
def _database(df: DataFrame) -> Database:
    return Database(df.sparkSession, f"{shared_folder(df.sparkSession)}/queries-{uuid.uuid4().hex}")


_CUSTOMER = {"name": {"type": "String", "required": True}, "balance": "Number", "segment": {"type": "String", "default": "NONE"}, "visits": {"type": "Integer", "default": 0}}


def _customers(t: Callable) -> Collection:
    rows = t("customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    model = _database(rows).model("customers", _CUSTOMER)
    model.insert_frame(rows)
    return model


def _shown(model: Collection) -> DataFrame:
    return model.df().select("_id", "name", "balance", "segment", F.col("visits").cast("int").alias("visits"))


_WAS = "select c_custkey::varchar as _id, c_name as name, c_acctbal as balance, c_mktsegment as segment, 0 as visits from customer"


@frame(f"select * from ({_WAS}) where balance > 0")
def write_insert_find(t):
    return _customers(t).find({"balance": {"$gt": 0}}).select("name balance segment visits").df().withColumn("visits", F.col("visits").cast("int"))


@frame(f"select _id, name, case when segment = 'BUILDING' then round(balance + 10, 2) else balance end as balance, segment, case when segment = 'BUILDING' then 1 else 0 end as visits from ({_WAS})")
def write_update_many(t):
    model = _customers(t)
    model.update_many({"segment": "BUILDING"}, {"$inc": {"balance": 10, "visits": 1}})
    return _shown(model).withColumn("balance", F.when(F.col("visits") > 0, F.round("balance", 2)).otherwise(F.col("balance")))


@frame(f"select _id, name, balance, case when _id = '1' then 'FIRST' else segment end as segment, visits from ({_WAS}) union all select 'new', 'made', 7.5, 'NONE', 3")
def write_upsert(t):
    """$setOnInsert counts for the document that isn't there only."""
    model = _customers(t)
    for key, segment in (("1", "FIRST"), ("new", "NONE")):
        model.update_one({"_id": key}, {"$set": {"segment": segment}, "$setOnInsert": {"name": "made", "balance": 7.5, "visits": 3}}, upsert=True)
    return _shown(model)


@frame(f"select _id, case when _id = '2' then 'other' else name end as name, case when _id = '2' then null else balance end as balance, case when _id = '2' then 'NONE' else segment end as segment, visits from ({_WAS}) where _id = '2' or not (segment = 'MACHINERY' or balance < 0)")
def write_replace_delete(t):
    model = _customers(t)
    model.delete_many({"$or": [{"segment": "MACHINERY"}, {"balance": {"$lt": 0}}], "_id": {"$ne": "2"}})
    model.replace_one({"_id": "2"}, {"name": "other"})
    return _shown(model)


@frame(f"select _id, name, balance, case when segment = 'AUTOMOBILE' then 'CARS' else segment end as segment, case when segment = 'AUTOMOBILE' then 2 else 0 end as visits from ({_WAS}) where segment <> 'FURNITURE' union all select 'x', 'bulk', 1.5, 'CARS', 2")
def write_bulk(t):
    model = _customers(t)
    model.bulk_write([
        {"insertOne": {"document": {"_id": "x", "name": "bulk", "balance": 1.5, "segment": "AUTOMOBILE"}}}, {"updateMany": {"filter": {"segment": "AUTOMOBILE"}, "update": {"$set": {"segment": "CARS"}}}},
        {"updateMany": {"filter": {"segment": "CARS"}, "update": {"$inc": {"visits": 2}}}}, {"deleteMany": {"filter": {"segment": "FURNITURE"}}},
    ])
    return _shown(model)


@frame("select o_orderstatus as _id, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def out_stage(t):
    db = _database(t("orders"))
    Pipeline(t("orders"), db.collection("any").context()).group({"_id": "$o_orderstatus", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}).out("totals").run()
    return db.collection("totals").df().withColumn("total", F.round("total", 2))


@frame("select coalesce(a.k, b.k) as _id, coalesce(b.n, a.n) as n from (select c_mktsegment as k, count(*) as n from customer group by 1) a full join (select upper(substr(c_mktsegment, 1, 1)) as k, max(c_nationkey)::bigint as n from customer group by 1 union all select 'BUILDING', 5) b on a.k = b.k")
def merge_stage(t):
    """Counts by segment; then a pipeline's rows, of which 'BUILDING' is there already and the others aren't."""
    db = _database(t("customer"))
    context = db.collection("any").context()
    Pipeline(t("customer"), context).group({"_id": "$c_mktsegment", "n": {"$sum": 1}}).out("totals").run()
    rows = t("customer").groupBy(F.upper(F.substring("c_mktsegment", 1, 1)).alias("_id")).agg(F.max("c_nationkey").cast("bigint").alias("n"))
    more = t("region").agg(F.lit("BUILDING").alias("_id"), F.lit(5).cast("bigint").alias("n"))
    Pipeline(rows.unionByName(more), context).merge({"into": "totals", "whenMatched": "replace"}).run()
    return db.collection("totals").df()


@frame("select s_suppkey::varchar as _id, s_name, s_acctbal, s_nationkey::bigint as s_nationkey from supplier")
def json_there_and_back(t):
    """A collection written as JSON, read as the raw source and appended to another collection."""
    rows = t("supplier").select(F.col("s_suppkey").cast("string").alias("_id"), "s_name", "s_acctbal", F.col("s_nationkey").cast("bigint").alias("s_nationkey"))
    db = _database(rows)
    first, second = db.model("first", Schema({}, strict=False)), db.model("second", Schema({}, strict=False))
    first.insert_frame(rows)
    first.export_json(f"{db.root}/_json")
    second.import_json(f"{db.root}/_json", lines=True)
    return second.df().select("_id", "s_name", "s_acctbal", "s_nationkey")


@frame(_WAS)
def backup_restore(t):
    model = _customers(t)
    model.backup()
    model.delete_many({})
    model.restore()
    return _shown(model)


@frame("""select c_mktsegment as _id, string_agg(c_name, '|' order by c_acctbal desc, c_custkey) as names from customer group by 1""")
def order_by_value(t):
    """A $sort by a field that is then overwritten, and documents whose root is replaced, keep their order."""
    stages = [{"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$addFields": {"c_acctbal": {"$multiply": ["$c_acctbal", -1]}, "doc": {"s": "$c_mktsegment", "n": "$c_name"}}}, {"$replaceRoot": "$doc"}, {"$group": {"_id": "$s", "names": {"$push": "$n"}}}]
    return aggregate(t("customer"), stages).withColumn("names", F.array_join("names", "|"))


@frame("""select string_agg(c_custkey::varchar, '|' order by c_acctbal desc, c_custkey) as ids from customer where c_mktsegment = 'BUILDING'""")
def order_in_facets(t):
    stages = [{"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$facet": {"found": [{"$match": {"c_mktsegment": "BUILDING"}}, {"$project": {"c_custkey": 1}}]}}]
    return aggregate(t("customer"), stages).select(F.array_join(F.expr("transform(found, x -> cast(x.c_custkey as string))"), "|").alias("ids"))


@frame("""select o_custkey as _id, string_agg(o_orderpriority || ',' || o_orderstatus, '|' order by o_totalprice, o_orderkey) as items from orders group by 1""")
def order_of_unwound(t):
    stages = [{"$sort": {"o_totalprice": 1, "o_orderkey": 1}}, {"$unwind": "$both"}, {"$group": {"_id": "$o_custkey", "items": {"$push": "$both"}}}]
    rows = aggregate(t("orders").withColumn("both", F.array("o_orderpriority", "o_orderstatus")), stages)
    pairs = F.expr("transform(sequence(0, size(items) - 1, 2), i -> concat(items[i], ',', items[i + 1]))")
    return rows.select("_id", F.array_join(pairs, "|").alias("items"))


# Fluent queries.
@frame("""select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_totalprice < 200000 and o_orderstatus in ('F', 'O') order by o_totalprice desc, o_orderkey limit 20 offset 5""")
def query_chain(t):
    return Query(lambda: t("orders")).where("o_totalprice").gt(100000).lt(200000).where("o_orderstatus").in_(["F", "O"]).select("o_orderkey o_totalprice").sort("-o_totalprice o_orderkey").skip(5).limit(20).df()


@frame("""select p_partkey, p_name, p_size from part where regexp_matches(p_name, '(?i)RED') and p_size % 5 = 0 and not (p_size > 40 or p_brand = 'Brand#3')""")
def query_regex_mod_nor(t):
    return Query(lambda: t("part")).where("p_name").regex("RED").mod("p_size", 5, 0).nor([{"p_size": {"$gt": 40}}, {"p_brand": "Brand#3"}]).select(["p_partkey", "p_name", "p_size"]).df()


@frame("""select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 15 offset 30""")
def query_paginate(t):
    return Query(lambda: t("customer")).sort({"c_acctbal": 1, "c_custkey": 1}).paginate(3, 15).select("c_custkey c_acctbal").df()


@frame(f"""select c_custkey from {_LONLAT} order by round({_metres(12.5, 41.5)} * 6371008.8, 3), c_custkey limit 10""")
def query_near(t):
    places = _places(t).withColumnRenamed("c_custkey", "_id")
    return Query(lambda: places).where("location").near({"center": [12.5, 41.5]}).max_distance(5000000).limit(10).select("_id").df().withColumnRenamed("_id", "c_custkey")


@frame("""select distinct o_orderpriority from orders""")
def query_distinct(t):
    return Query(lambda: t("orders")).distinct("o_orderpriority")


@frame("""select p_partkey, contains(lower(p_name), 'red')::int + contains(lower(p_brand), 'red')::int + contains(lower(p_type), 'red')::int + contains(lower(p_name), 'ring')::int + contains(lower(p_brand), 'ring')::int + contains(lower(p_type), 'ring')::int as score from part where p_size < 10""")
def query_meta_score(t):
    return Query(lambda: t("part"), conditions={"p_size": {"$lt": 10}}).meta("score", "red ring").select("p_partkey score").df()


@frame("""select o_custkey as _id, array_to_string((list(o_orderstatus order by o_orderkey))[-3:], '') as s from orders group by 1""")
def query_slice(t):
    lists = aggregate(t("orders"), [{"$sort": {"o_orderkey": 1}}, {"$group": {"_id": "$o_custkey", "s": {"$push": "$o_orderstatus"}}}])
    return Query(lambda: lists).slice("s", -3).df().withColumn("s", F.array_join("s", ""))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_flag"](spark, sf_dir)
