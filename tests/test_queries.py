"""Every driver query against its SQL, at the smallest size; plans of the ones that must push down or join well."""

from __future__ import annotations

import pytest

import __spark_entry__
from compare import differences
from papyra import queries
from papyra.plans.pipeline import aggregate


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_query(spark, sf, key):
    out = queries.QUERIES[key](spark, sf)
    assert differences(out, sf, queries.SQL[key]) == ""
    # At the smallest size no hour and no day has enough rows for the series.
    assert not (queries.QUERIES[key](spark, sf.replace("0.001", "0.01")) if key in ("densify_hours", "densify_days") else out).isEmpty()


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql(spark, sf, key):
    assert queries.QUERIES[key](spark, sf).count() > 0


def test_entry(spark, sf):
    assert [r.asDict() for r in __spark_entry__.entry(spark).collect()] and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    found = plan(queries.QUERIES["match_ne_nin"](spark, sf))
    assert "PushedFilters: [" in found and "Not(EqualTo(o_orderstatus,F))" in found.replace("Or(Not(EqualTo(o_orderstatus,F)),IsNull(o_orderstatus))", "Not(EqualTo(o_orderstatus,F))")
    assert "o_orderdate" not in found.split("ReadSchema")[1]


def test_lookups_are_hash_or_merge_joins(spark, sf):
    for key in ("lookup_array", "lookup_size_sum", "lookup_unwind", "lookup_mixed_keys"):
        found = plan(queries.QUERIES[key](spark, sf))
        assert "NestedLoop" not in found and "Cartesian" not in found, key


def test_summaries_of_lookups_collect_nothing(spark, sf):
    assert "collect_list" not in plan(queries.QUERIES["lookup_size_sum"](spark, sf))


def test_presence_of_lookups_is_a_semi_or_anti_join(spark, sf):
    for key, kind in (("lookup_semi", "LeftSemi"), ("lookup_anti", "LeftAnti")):
        found = plan(queries.QUERIES[key](spark, sf))
        assert "collect_list" not in found and kind in found


def test_sort_and_limit_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(queries.QUERIES["sort_skip_limit"](spark, sf))


def test_unknown_names_raise(spark):
    df = spark.range(1)
    for stages in ([{"$nope": 1}], [{"$match": {"id": {"$nope": 1}}}], [{"$project": {"a": {"$nope": 1}}}], [{"$group": {"_id": None, "a": {"$nope": 1}}}], [{"$match": {}, "$limit": 1}]):
        with pytest.raises(ValueError):
            aggregate(df, stages)


def test_populate_array_takes_every_customer_with_orders(spark, sf):
    ids = {r.o_custkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect()}
    assert {r._id for r in queries.QUERIES["populate_array"](spark, sf).select("_id").collect()} == ids and max(ids) >= 50


def test_merge_upsert_takes_every_customer_and_inserts(spark, sf):
    customers = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    rows = queries.QUERIES["merge_upsert"](spark, sf).collect()
    assert customers <= {r.k for r in rows} and {r.k for r in rows if r.w is None}.isdisjoint(customers) and any(r.w is None for r in rows)


def test_distinct_takes_every_order(spark, sf):
    found = {r[0] for r in queries.QUERIES["query_distinct"](spark, sf).collect()}
    assert found == {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority").collect()}


def test_polygons_at_every_place(spark, tmp_path):
    """361 * 179 keys are all places that keys can have; three of them are on the polygon's slanting edge."""
    spark.range(361 * 179).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    for key in ("geo_polygon", "geo_intersects"):
        assert differences(queries.QUERIES[key](spark, str(tmp_path)), str(tmp_path), queries.SQL[key]) == ""
