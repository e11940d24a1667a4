"""Filters on documents with missing fields, arrays and nested values, and against a small evaluator."""

from __future__ import annotations

import random
import re

import pytest

from papyra.functions.filters import compile_filter
from papyra.functions.paths import Scope


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, 1, ["x", "y"], "Apple", (3, [(1, "u"), (2, "v")])), (2, None, [], "banana", (None, [])), (3, 0, None, None, None), (4, -7, ["y", None], "CHERRY", (5, None)), (5, 12, ["z"], "", (3, [(9, None)]))],
        "_id int, a int, t array<string>, s string, p struct<q: int, r: array<struct<n: int, m: string>>>",
    )


def ids(docs, spec):
    return sorted(r._id for r in docs.where(compile_filter(spec, Scope(docs))).collect())


@pytest.mark.parametrize(
    ("spec", "wanted"),
    [
        ({}, [1, 2, 3, 4, 5]), ({"a": 1}, [1]), ({"a": None}, [2]), ({"a": "1"}, []), ({"s": re.compile("^a", re.I)}, [1]), ({"t": ["x", "y"]}, [1]), ({"t": []}, [2]),
        ({"a": {"$gt": 0}}, [1, 5]), ({"a": {"$gte": 0, "$lt": 12}}, [1, 3]), ({"a": {"$lte": 0}}, [3, 4]), ({"a": {"$gt": "x"}}, []), ({"a": {"$ne": 1}}, [2, 3, 4, 5]), ({"a": {"$ne": None}}, [1, 3, 4, 5]),
        ({"a": {"$in": [1, 0, 99]}}, [1, 3]), ({"a": {"$in": [None, 1]}}, [1, 2]), ({"a": {"$nin": [1, 0]}}, [2, 4, 5]), ({"a": {"$in": []}}, []), ({"a": {"$nin": []}}, [1, 2, 3, 4, 5]),
        ({"t": {"$in": ["y"]}}, [1, 4]), ({"t": {"$nin": ["y"]}}, [2, 3, 5]), ({"t": {"$all": ["x", "y"]}}, [1]), ({"t": {"$all": []}}, []), ({"t": {"$size": 0}}, [2]), ({"t": {"$size": 2}}, [1, 4]), ({"a": {"$size": 1}}, []),
        ({"t": {"$elemMatch": {"$regex": "^[xz]"}}}, [1, 5]), ({"p.r": {"$elemMatch": {"n": {"$gt": 1}, "m": {"$exists": True}}}}, [1]), ({"p.r.n": {"$in": [2, 9]}}, [1, 5]), ({"p.r.0.n": 1}, [1]), ({"p.q": 3}, [1, 5]), ({"p.nope.x": 1}, []), ({"nope": {"$exists": False}}, [1, 2, 3, 4, 5]),
        ({"a": {"$exists": True}}, [1, 3, 4, 5]), ({"a": {"$exists": False}}, [2]), ({"a": {"$type": "number"}}, [1, 3, 4, 5]), ({"t": {"$type": "object"}}, [1, 2, 4, 5]), ({"s": {"$type": ["number", "string"]}}, [1, 2, 4, 5]),
        ({"a": {"$mod": [4, 1]}}, [1]), ({"a": {"$mod": [3, -1]}}, [4]), ({"a": {"$mod": [0, 0]}}, []), ({"s": {"$regex": "an"}}, [2]), ({"s": {"$regex": "^cherry$", "$options": "i"}}, [4]), ({"a": {"$regex": "1"}}, []),
        ({"s": {"$text": "APP"}}, [1]), ({"$text": {"$search": "an"}}, [2]), ({"$or": []}, []), ({"$and": []}, [1, 2, 3, 4, 5]), ({"$nor": []}, [1, 2, 3, 4, 5]), ({"$nor": [{"a": {"$gt": 0}}]}, [2, 3, 4]), ({"a": {"$not": {"$gt": 0}}}, [2, 3, 4]), ({"$not": {"s": ""}}, [1, 2, 3, 4]),
        ({"$or": [{"a": 1}, {"s": "banana"}]}, [1, 2]), ({"$expr": {"$gt": ["$a", "$_id"]}}, [5]), ({"$where": "a > 0 and s = ''"}, [5]), ({"a": {"$eq": 12}}, [5]), ({"$comment": "x", "a": 1}, [1]),
        ({"$jsonSchema": {"required": ["s"], "properties": {"a": {"type": "integer", "minimum": 0}, "s": {"minLength": 1, "pattern": "[aA]"}}}}, [1, 2]), ({"$jsonSchema": {"properties": {"p": {"properties": {"q": {"enum": [3]}}}}}}, [1, 2, 3, 5]),
    ],
)
def test_filter(docs, spec, wanted):
    assert ids(docs, spec) == wanted


def matches(doc, spec):
    """The rules for top-level numbers, two-valued."""
    for key, want in spec.items():
        if key in ("$and", "$or", "$nor"):
            parts = [matches(doc, x) for x in want]
            ok = all(parts) if key == "$and" else any(parts) if key == "$or" else not any(parts)
        else:
            x, ok = doc[key], True
            for op, v in want.items():
                ok &= {"$gt": lambda: x is not None and x > v, "$lte": lambda: x is not None and x <= v, "$ne": lambda: x != v, "$in": lambda: x in v, "$nin": lambda: x not in v, "$exists": lambda: (x is not None) == v, "$eq": lambda: x == v}[op]()
        if not ok:
            return False
    return True


def test_random_filters(spark):
    r = random.Random(11)
    rows = [(i, r.choice([None, *range(5)]), r.choice([None, *range(5)])) for i in range(60)]
    df = spark.createDataFrame(rows, "_id int, a int, b int").cache()

    def leaf():
        op = r.choice(["$gt", "$lte", "$ne", "$in", "$nin", "$exists", "$eq"])
        return {r.choice("ab"): {op: [r.randrange(5), r.randrange(5)] if op in ("$in", "$nin") else r.random() < 0.5 if op == "$exists" else r.randrange(5)}}

    def tree(depth):
        return leaf() if depth == 0 or r.random() < 0.3 else {r.choice(["$and", "$or", "$nor"]): [tree(depth - 1) for _ in range(r.randrange(1, 4))]}

    for _ in range(40):
        spec = tree(3)
        assert ids(df, spec) == [i for i, a, b in rows if matches({"a": a, "b": b}, spec)], spec


def test_edges_of_polygons_intersect_them_but_are_not_within(spark):
    """Points on a grid of halves, and none; by the signs of cross products."""
    places = [None, *((x / 2, y / 2) for x in range(-3, 14) for y in range(-3, 14))]
    df = spark.createDataFrame([(i, None if p is None else list(p)) for i, p in enumerate(places)], "_id int, at array<double>").cache()

    def side(p, a, b):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def of(p, ring):
        """1 inside a convex ring, 0 on an edge, -1 outside."""
        turns = [side(p, a, b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
        return 1 if all(t > 0 for t in turns) or all(t < 0 for t in turns) else 0 if all(t >= 0 for t in turns) or all(t <= 0 for t in turns) else -1

    def wanted(keep):
        return [i for i, p in enumerate(places) if p is not None and keep(p)]

    rings = [[[0, 0], [6, 0], [6, 4]], [[6, 4], [6, 0], [0, 0]], [[0, 0], [4, 0], [4, 4], [0, 4]], [[0, 3], [3, 0], [6, 3], [3, 6]], [[-1, 0], [5, 2], [1, 6]]]
    for ring in rings:
        inside, touching = wanted(lambda p: of(p, ring) > 0), wanted(lambda p: of(p, ring) >= 0)  # noqa: B023
        assert inside and len(touching) >= len(inside) + 3
        for shape in ({"$polygon": ring}, {"$polygon": [*ring, ring[0]]}, {"$geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}}):
            assert ids(df, {"at": {"$geoWithin": shape}}) == inside
        assert ids(df, {"at": {"$geoIntersects": shape}}) == touching
        assert ids(df, {"$nor": [{"at": {"$geoIntersects": shape}}]}) == sorted(set(range(len(places))) - set(touching))
    outer, hole = rings[2], [[1, 1], [3, 1], [1, 3]]
    shape = {"$geometry": {"type": "Polygon", "coordinates": [[*outer, outer[0]], [*hole, hole[0]]]}}
    assert ids(df, {"at": {"$geoWithin": shape}}) == wanted(lambda p: of(p, outer) > 0 and of(p, hole) < 0)
    assert ids(df, {"at": {"$geoIntersects": shape}}) == wanted(lambda p: of(p, outer) >= 0 and of(p, hole) <= 0)
