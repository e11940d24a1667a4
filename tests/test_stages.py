"""Stages, accumulators, updates and expressions on small documents."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from papyra.functions.paths import Scope
from papyra.functions.updates import compile_update
from papyra.operators import series
from papyra.plans.pipeline import Context, Pipeline, aggregate


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def things(spark):
    return spark.createDataFrame([(1, "a", 5, ["x", "y"]), (2, "a", None, []), (3, "b", 7, None), (4, None, 2, ["z"]), (5, "b", 7, ["x"])], "_id int, k string, v int, t array<string>")


def test_unwind(things):
    found = rows(aggregate(things, [{"$unwind": {"path": "$t", "includeArrayIndex": "i"}}, {"$project": {"_id": 1, "t": 1, "i": 1}}]))
    assert sorted(map(str, found)) == sorted(map(str, [{"_id": 1, "t": "x", "i": 0}, {"_id": 1, "t": "y", "i": 1}, {"_id": 3, "t": None, "i": None}, {"_id": 4, "t": "z", "i": 0}, {"_id": 5, "t": "x", "i": 0}]))
    assert len(rows(aggregate(things, [{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}]))) == 6
    assert len(rows(aggregate(things, [{"$unwind": "$k"}]))) == 5


def test_nested_unwind(spark):
    df = spark.createDataFrame([(1, (1, [1, 2]))], "_id int, p struct<o: int, q: array<int>>")
    assert [r["p"] for r in rows(aggregate(df, [{"$unwind": "$p.q"}]))] == [{"o": 1, "q": 1}, {"o": 1, "q": 2}]


def test_groups_with_order_and_nulls(things):
    found = rows(aggregate(things, [{"$sort": {"v": -1, "_id": 1}}, {"$group": {"_id": "$k", "first": {"$first": "$v"}, "last": {"$last": "$v"}, "all": {"$push": "$v"}, "set": {"$addToSet": "$v"}, "sum": {"$sum": "$v"}, "n": {"$count": {}}}}, {"$sort": {"_id": 1}}]))
    assert found == [
        {"_id": None, "first": 2, "last": 2, "all": [2], "set": [2], "sum": 2, "n": 1},
        {"_id": "a", "first": 5, "last": None, "all": [5, None], "set": [5], "sum": 5, "n": 2},
        {"_id": "b", "first": 7, "last": 7, "all": [7, 7], "set": [7], "sum": 14, "n": 2},
    ]
    assert rows(aggregate(things.limit(0), [{"$group": {"_id": None, "n": {"$sum": 1}}}])) == []
    assert rows(aggregate(things.limit(0), [{"$count": "n"}])) == [{"n": 0}]


def test_descending_text_order(things):
    found = rows(aggregate(things, [{"$sort": {"k": -1, "_id": 1}}, {"$group": {"_id": None, "ids": {"$push": "$_id"}, "first": {"$first": "$k"}}}]))
    assert found == [{"_id": None, "ids": [3, 5, 1, 2, 4], "first": "b"}]


def test_merge_objects_of_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 1}), (2, {"b": 2}), (3, None)], "_id int, m map<string, int>")
    assert rows(aggregate(df, [{"$sort": {"_id": 1}}, {"$group": {"_id": None, "m": {"$mergeObjects": "$m"}}}])) == [{"_id": None, "m": {"a": 1, "b": 2}}]


def test_buckets(things):
    assert rows(aggregate(things, [{"$bucket": {"groupBy": "$v", "boundaries": [0, 5, 7]}}])) == [{"_id": 0, "count": 1}, {"_id": 5, "count": 1}]
    assert {r["_id"]: r["count"] for r in rows(aggregate(things, [{"$bucket": {"groupBy": "$v", "boundaries": [0, 5], "default": -1}}]))} == {0: 1, -1: 4}
    ten = things.sparkSession.range(10).withColumnRenamed("id", "x")
    assert [(r["_id"]["min"], r["_id"]["max"], r["count"]) for r in rows(aggregate(ten, [{"$bucketAuto": {"groupBy": "$x", "buckets": 3}}]))] == [(0, 3, 4), (4, 7, 4), (8, 9, 2)]
    assert len(rows(aggregate(ten, [{"$bucketAuto": {"groupBy": "$x", "buckets": 7}}]))) == 5
    with pytest.raises(ValueError):
        aggregate(things, [{"$bucket": {"groupBy": "$v", "boundaries": [5, 5]}}])


def test_facet(things):
    (found,) = rows(aggregate(things, [{"$facet": {"n": [{"$count": "n"}], "a": [{"$match": {"k": "a"}}, {"$project": {"_id": 1}}], "none": [{"$match": {"k": "q"}}]}}]))
    assert found["n"] == [{"n": 5}] and sorted(x["_id"] for x in found["a"]) == [1, 2] and found["none"] == []


def test_lookup_of_missing_keys(spark):
    a = spark.createDataFrame([(1, "1"), (2, "x"), (3, None)], "_id int, key string")
    b = spark.createDataFrame([(1.0, "one"), (None, "none"), (2.5, "half")], "n double, w string")
    found = rows(aggregate(a, [{"$lookup": {"from": "b", "localField": "key", "foreignField": "n", "as": "f"}}, {"$sort": {"_id": 1}}], {"b": b}))
    assert [[x["w"] for x in r["f"]] for r in found] == [["one"], [], ["none"]]


def test_order_outlives_joins(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "n int, k int")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "k int, w string")
    look = {"$lookup": {"from": "b", "localField": "k", "foreignField": "k", "as": "f"}}
    wanted = list(range(29, 19, -1))
    for after in ([], [{"$unwind": "$f"}], [{"$project": {"n": 1, "size": {"$size": "$f"}}}], [{"$setWindowFields": {"partitionBy": "$k", "sortBy": {"n": 1}, "output": {"r": {"$rank": {}}}}}]):
        assert [r["n"] for r in rows(aggregate(a, [{"$sort": {"n": -1}}, {"$limit": 10}, look, *after], {"b": b}))] == wanted


def test_graph_with_cycles(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", None)], "_id string, next string")
    spec = {"from": "n", "startWith": "$next", "connectFromField": "next", "connectToField": "_id", "as": "seen", "depthField": "d"}
    found = {r["_id"]: [(x["_id"], x["d"]) for x in r["seen"]] for r in rows(aggregate(nodes, [{"$graphLookup": spec}], {"n": nodes}))}
    assert found == {"a": [("b", 0), ("c", 1), ("a", 2)], "b": [("c", 0), ("a", 1), ("b", 2)], "c": [("a", 0), ("b", 1), ("c", 2)], "d": [("d", 0)], "e": []}
    near = {r["_id"]: len(r["seen"]) for r in rows(aggregate(nodes, [{"$graphLookup": {**spec, "maxDepth": 1, "restrictSearchWithMatch": {"_id": {"$ne": "c"}}}}], {"n": nodes}))}
    assert near == {"a": 1, "b": 0, "c": 2, "d": 1, "e": 0}


def test_a_long_graph(spark):
    """A path of 40 nodes: as many rounds of joins, with plans that stay small."""
    nodes = spark.createDataFrame([(i, i + 1) for i in range(40)], "_id int, next int")
    found = aggregate(nodes.where("_id = 0"), [{"$graphLookup": {"from": "n", "startWith": "$next", "connectFromField": "next", "connectToField": "_id", "as": "seen"}}], {"n": nodes})
    assert [x["_id"] for x in rows(found)[0]["seen"]] == list(range(1, 40))


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_over_all_rows(spark, seed):
    """Values are carried, and interpolated, over ranges that hold none."""
    r = random.Random(seed)
    held = [(i, r.random() if r.random() < (0.02 if seed == 1 else 0.5) else None, i if i % 7 == 0 else None) for i in range(400)]
    r.shuffle(held)
    out = aggregate(spark.createDataFrame(held, "i int, v double, w int").repartition(7), [{"$fill": {"sortBy": {"i": -1}, "output": {"v": "linear", "w": "locf", "i": {"value": 0}}}}]).collect()
    known = sorted((i, v) for i, v, _ in held if v is not None)
    for x in out:
        low, high = [k for k in known if k[0] <= x.i], [k for k in known if k[0] >= x.i]
        wanted = None if not low or not high else low[-1][1] if low[-1] == high[0] else low[-1][1] + (high[0][1] - low[-1][1]) * (x.i - low[-1][0]) / (high[0][0] - low[-1][0])
        assert (x.v is None) == (wanted is None) and (wanted is None or abs(x.v - wanted) < 1e-9)
        assert x.w == next((k for k in range(x.i, 400) if k % 7 == 0), None)
    assert len(out) == 400


def test_densify_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "GRID", 10)
    ints = aggregate(spark.createDataFrame([(0,), (95,)], "n int"), [{"$densify": {"field": "n", "range": {"step": 3, "bounds": "full"}}}])
    assert sorted(r.n for r in ints.collect()) == sorted({*range(0, 96, 3), 95})
    floats = aggregate(spark.createDataFrame([(0.0, "a"), (2.5, "a"), (1.0, "b")], "n double, k string"), [{"$densify": {"field": "n", "partitionByFields": ["k"], "range": {"step": 0.1}}}])
    assert sorted(round(r.n, 6) for r in floats.where("k = 'a'").collect()) == [round(i * 0.1, 6) for i in range(26)]
    day = dt.date
    months = aggregate(spark.createDataFrame([(day(2020, 1, 31),), (day(2022, 2, 1),)], "d date"), [{"$densify": {"field": "d", "range": {"step": 1, "unit": "month"}}}])
    found = sorted(r.d for r in months.collect())
    assert len(found) == 26 and found[1] == day(2020, 2, 29) and found[2] == day(2020, 3, 31) and months.schema["d"].dataType.simpleString() == "date"
    back = aggregate(spark.createDataFrame([(1,)], "n int"), [{"$densify": {"field": "n", "range": {"step": 1, "bounds": [5, 2]}}}])
    assert back.count() == 1


def test_densify_and_fill(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("p", t(0), 1.0), ("p", t(2), None), ("p", t(6), 7.0), ("p", dt.datetime(2024, 1, 1, 2, 30), 9.0), ("q", t(1), None)], "k string, at timestamp_ntz, v double")
    dense = aggregate(df, [{"$densify": {"field": "at", "partitionByFields": ["k"], "range": {"step": 2, "unit": "hours"}}}])
    assert sorted((r["k"], r["at"], r["v"]) for r in rows(dense.where("v is not null or minute(at) = 0").na.fill(-1.0))) == sorted([("p", t(0), 1.0), ("p", t(2), -1.0), ("p", dt.datetime(2024, 1, 1, 2, 30), 9.0), ("p", t(4), -1.0), ("p", t(6), 7.0), ("q", t(1), -1.0)])
    numbers = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "i int, v double")
    assert [r["v"] for r in rows(aggregate(numbers, [{"$fill": {"sortBy": {"i": 1}, "output": {"v": "linear"}}}]).orderBy("i"))] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert [r["v"] for r in rows(aggregate(numbers, [{"$fill": {"sortBy": {"i": 1}, "output": {"v": "locf"}}}]).orderBy("i"))] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    full = aggregate(spark.createDataFrame([(1, 1), (2, 5)], "k int, n int"), [{"$densify": {"field": "n", "partitionByFields": ["k"], "range": {"step": 2, "bounds": "full"}}}])
    assert sorted((r["k"], r["n"]) for r in rows(full)) == [(1, 1), (1, 3), (1, 5), (2, 1), (2, 3), (2, 5)]


def test_shape_stages(spark, things):
    (found,) = rows(aggregate(things, [{"$match": {"_id": 1}}, {"$set": {"o.p": "$v", "t": {"$size": "$t"}}}, {"$unset": "v"}, {"$project": {"_id": 0, "k": 0}}]))
    assert found == {"t": 2, "o": {"p": 5}}
    assert rows(aggregate(things, [{"$replaceRoot": {"newRoot": {"x": "$v"}}}, {"$match": {"x": 2}}])) == [{"x": 2}]
    assert len(rows(aggregate(things, [{"$sample": {"size": 3}}]))) == 3
    assert rows(aggregate(things, [{"$redact": {"if": {"$eq": ["$k", "a"]}, "then": "$$PRUNE", "else": "$$KEEP"}}, {"$count": "n"}])) == [{"n": 3}]
    assert rows(aggregate(things, [{"$sortByCount": "k"}]))[:2] == [{"_id": "a", "count": 2}, {"_id": "b", "count": 2}]
    built = Pipeline(things, Context(spark)).match({"k": "b"}).group({"_id": "$k", "n": {"$sum": 1}}).sort({"_id": 1}).limit(5)
    assert [r.asDict() for r in built.exec()] == [{"_id": "b", "n": 2}] and len(built.pipeline()) == 4
    assert built.option(allow_disk_use=True, comment="c").options == {"allow_disk_use": True, "comment": "c"}


def test_expressions(things):
    spec = {"a": {"$arrayElemAt": ["$t", -1]}, "s": {"$sum": ["$v", 1]}, "z": {"$sum": "$v"}, "d": {"$divide": ["$v", 0]}, "c": {"$cond": ["$k", 1, 2]}, "n": {"$ifNull": ["$v", -1]}, "l": {"$slice": ["$t", 1]}, "r": "$$ROOT._id"}
    assert rows(aggregate(things, [{"$project": spec}, {"$limit": 1}])) == [{"a": "y", "s": 6.0, "z": 0, "d": None, "c": 1, "n": 5, "l": ["x"], "r": 1}]


def changed(df, update, insert=False):
    return rows(df.withColumns(compile_update(update, Scope(df), insert)))


def test_updates(spark):
    df = spark.createDataFrame([(1, 5, None, ["a", "b", "a"], [1, 5, 9], (1, "x"))], "_id int, n int, m double, t array<string>, v array<int>, p struct<q: int, r: string>")
    (r,) = changed(df, {"$inc": {"n": 2, "m": 1.5}, "$push": {"t": "c", "fresh": 3}, "$pull": {"v": {"$gt": 4}}, "$set": {"p.q": 9, "s": "new"}, "$setOnInsert": {"never": 1}})
    assert (r["n"], r["m"], r["t"], r["fresh"], r["v"], r["p"], r["s"]) == (7, 1.5, ["a", "b", "a", "c"], [3], [1], {"q": 9, "r": "x"}, "new") and "never" not in r
    (r,) = changed(df, {"$pullAll": {"t": ["b"]}, "$pop": {"v": -1}, "$mul": {"n": 3, "gone": 4}, "$min": {"m": 2.0}, "$max": {"p": None}})
    assert (r["t"], r["v"], r["n"], r["gone"], r["m"]) == (["a", "a"], [5, 9], 15, 0, 2.0)
    (r,) = changed(df, {"$addToSet": {"t": {"$each": ["b", "z"]}}, "$bit": {"n": {"xor": 1}}, "$rename": {"m": "mm"}, "$unset": {"v": ""}, "$setOnInsert": {"made": True}}, insert=True)
    assert (r["t"], r["n"], r["mm"], r["v"], r["made"]) == (["a", "b", "a", "z"], 4, None, None, True)
    (r,) = changed(df, {"n": 1})
    assert r["n"] == 1
    with pytest.raises(ValueError):
        changed(df, {"$nope": {"n": 1}})
    with pytest.raises(TypeError):
        changed(df, {"$push": {"n": 1}})


def test_geo_across_the_date_line(spark):
    df = spark.createDataFrame([(1, [179.5, 0.0]), (2, [-179.5, 0.0]), (3, [0.0, 0.0]), (4, None)], "_id int, p array<double>")
    near = aggregate(df, [{"$geoNear": {"near": [180.0, 0.0], "key": "p", "maxDistance": 100000}}])
    assert sorted(r["_id"] for r in rows(near)) == [1, 2] and near.where(F.abs(F.col("distance") - 55597.5) < 100).count() == 2
    assert [r["_id"] for r in rows(aggregate(df, [{"$match": {"p": {"$geoWithin": {"$box": [[170, -1], [-170, 1]]}}}}]))] == [1, 2]


def test_order_is_by_value(spark):
    """A sort's order stays what it was, whatever becomes of the field."""
    df = spark.createDataFrame([(i, i % 3, [i, -i], (i,)) for i in range(6)], "_id int, a int, t array<int>, s struct<x: int>")
    push = {"$group": {"_id": None, "all": {"$push": "$_id"}, "first": {"$first": "$_id"}, "last": {"$last": "$_id"}}}
    want = {"_id": None, "all": [0, 3, 1, 4, 2, 5], "first": 0, "last": 5}
    for between in ([], [{"$addFields": {"a": {"$multiply": ["$a", -1]}}}], [{"$project": {"_id": 1}}], [{"$unset": "a"}], [{"$project": {"_id": 1, "a": "$t"}}]):
        assert rows(aggregate(df, [{"$sort": {"a": 1}}, *between, push])) == [want]
    found = rows(aggregate(df, [{"$sort": {"a": -1}}, {"$unwind": "$t"}, {"$group": {"_id": None, "all": {"$push": "$t"}}}]))
    assert found == [{"_id": None, "all": [2, -2, 5, -5, 1, -1, 4, -4, 0, 0, 3, -3]}]
    found = rows(aggregate(df, [{"$sort": {"a": 1, "_id": -1}}, {"$replaceRoot": "$s"}, {"$group": {"_id": None, "all": {"$push": "$x"}}}]))
    assert found == [{"_id": None, "all": [3, 0, 4, 1, 5, 2]}]
    found = rows(aggregate(df, [{"$sort": {"a": -1}}, {"$facet": {"x": [{"$project": {"_id": 1}}], "y": [push], "z": [{"$sort": {"_id": -1}}, {"$limit": 2}, {"$project": {"_id": 1}}]}}]))
    assert [d["_id"] for d in found[0]["x"]] == [2, 5, 1, 4, 0, 3] == found[0]["y"][0]["all"] and [d["_id"] for d in found[0]["z"]] == [5, 4]
    out = aggregate(df, [{"$sort": {"a": 1}}, {"$lookup": {"from": "o", "localField": "_id", "foreignField": "k", "as": "o"}}], {"o": spark.range(3).withColumnRenamed("id", "k")})
    assert out.columns == ["_id", "a", "t", "s", "o"] and [r["_id"] for r in rows(out)] == want["all"]
    assert rows(aggregate(spark.createDataFrame([("ab", 1), ("c", 2)], "x string, y int"), [{"$sort": {"x": 1}}, {"$unset": "x"}, {"$match": {"$text": {"$search": "ab"}}}])) == []


def test_lookups_for_presence_collect_nothing(spark):
    """Semi and anti joins; where the array is read later, it is still made."""
    df, other = spark.createDataFrame([(1,), (2,), (None,)], "a int"), {"o": spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")}
    look = {"$lookup": {"from": "o", "localField": "a", "foreignField": "k", "as": "o"}}
    for ask, want in (({"o": {"$size": 0}}, [2]), ({"o": {"$ne": []}}, [None, 1]), ({"o.0": {"$exists": True}}, [None, 1]), ({"$expr": {"$gt": [{"$size": "$o"}, 0]}}, [None, 1]), ({"o": {"$not": {"$size": 0}}}, [None, 1])):
        out = aggregate(df, [look, {"$match": ask}, {"$project": {"a": 1}}], other)
        assert sorted((r["a"] for r in rows(out)), key=lambda x: x or 0) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and ("LeftAnti" if want == [2] else "LeftSemi") in plan
    kept = rows(aggregate(df, [look, {"$match": {"o": {"$ne": []}}}, {"$match": {"a": 1}}], other))
    assert len(kept) == 1 and sorted(d["v"] for d in kept[0]["o"]) == ["x", "y"]
    assert rows(aggregate(df, [look, {"$match": {"o": {"$size": 0}}}], other)) == [{"a": 2, "o": []}]


def test_merge_takes_rows_with_equal_keys_in_order(spark):
    old = spark.createDataFrame([(1, "old")], "_id int, v string")
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (2, "d", 4)], "_id int, v string, n int")
    for way, how, want in ((1, "replace", {1: "b", 2: "d"}), (-1, "replace", {1: "a", 2: "c"}), (1, "keepExisting", {1: "old", 2: "c"}), (-1, "merge", {1: "a", 2: "c"})):
        held = {}
        aggregate(new, [{"$sort": {"n": way}}, {"$project": {"_id": 1, "v": 1}}, {"$merge": {"into": "t", "whenMatched": how}}], {"t": old}, held.__setitem__)
        assert {r._id: r.v for r in held["t"].collect()} == want and held["t"].columns == ["_id", "v"]
