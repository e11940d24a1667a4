"""Collections: schemas, documents, writes, queries, backups, streams."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

import papyra
from papyra.plans.query import Query
from papyra.sources import Conflict, Store


@pytest.fixture
def db(spark, tmp_path):
    return papyra.connect(spark, f"{tmp_path}/db")


@pytest.fixture
def blog(db):
    user = papyra.Schema({
        "username": {"type": "String", "required": True}, "email": {"type": "String", "required": True, "match": re.compile("@")}, "age": {"type": "Integer", "required": True, "min": [0, "age below 0"]},
        "isActive": {"type": "Boolean", "default": True}, "tags": {"type": list, "default": []}, "profile": {"type": {"avatar": "String", "bio": "String"}, "default": {"avatar": "default.png", "bio": ""}}, "lastLogin": "Date",
    })
    user.virtual("isAdult").get(lambda field: field("age") >= 18)
    user.virtual("posts", {"ref": "Post", "local_field": "_id", "foreign_field": "author"})
    user.virtual("postCount", {"ref": "Post", "local_field": "_id", "foreign_field": "author", "count": True})
    user.method("label", lambda self: f"{self.username} ({self.age})").static("by_email", lambda self, email: self.find_one({"email": email}))
    post = papyra.Schema({"title": {"type": "String", "required": True}, "author": {"type": "ObjectId", "ref": "User"}, "editors": [{"type": "ObjectId", "ref": "User"}], "tags": ["String"], "likes": {"type": "Integer", "default": 0}})
    post.index({"title": "text"})
    post.path("editors").options["ref"] = "User"
    users, posts = db.model("User", user), db.model("Post", post)
    a, b = users.create([{"username": "ann", "email": "ann@x", "age": 25}, {"username": "bob", "email": "bob@x", "age": 30}])
    posts.create([{"title": "Intro to Node.js", "author": a.id, "tags": ["tutorial"], "likes": 10, "editors": [b.id, "missing", a.id]}, {"title": "Other", "author": b.id, "tags": ["tutorial"], "likes": 15}])
    return users, posts


def test_create_and_read(blog):
    users, _ = blog
    ann = users.by_email("ann@x")
    assert ann.label() == "ann (25)" and ann.isAdult is True and ann.profile == {"avatar": "default.png", "bio": ""} and ann["__v"] == 0 and len(ann.id) == 24 and ann.createdAt
    assert users.count_documents() == 2 and users.exists({"age": 30}) and not users.exists({"age": 31}) and sorted(users.distinct("age")) == [25, 30]
    assert users.find_by_id("nope") is None and users.find().or_fail().collect()
    with pytest.raises(LookupError):
        users.find({"age": 1}).or_fail().collect()


def test_validation(blog):
    users, _ = blog
    with pytest.raises(papyra.ValidationError, match="doesn't match.*age below 0"):
        users.create({"username": "x", "email": "bad", "age": -1})
    with pytest.raises(papyra.ValidationError, match="email is required"):
        users.create({"username": "x", "age": 1})
    with pytest.raises(papyra.ValidationError, match="duplicate _id"):
        users.create([{"_id": "1", "username": "x", "email": "@", "age": 1}, {"_id": "1", "username": "y", "email": "@", "age": 1}])
    assert len(users.insert_many([{"username": "ok", "email": "@", "age": 1}, {"username": "no", "email": "@", "age": -4}], ordered=False)) == 1
    assert users.schema.rejects(users.df().withColumn("age", F.lit(-1))).count() == 3


def test_queries_of_the_blog(blog):
    users, posts = blog
    found = posts.find().sort("-likes").populate("author", "username").collect()
    assert [(d.likes, d.author["username"]) for d in found] == [(15, "bob"), (10, "ann")]
    assert posts.find().where("likes").gt(5).lt(12).where("tags").in_(["tutorial"]).select("title likes").lean().collect() == [{"_id": found[1].id, "title": "Intro to Node.js", "likes": 10}]
    assert posts.find({"title": re.compile(r"node\.js", re.I)}).count_documents() == 1 and posts.find().text({"$search": "OTHER"}).count_documents() == 1
    assert [x["username"] for x in posts.find({"likes": 10}).populate("editors").one().editors] == ["bob", "ann"]
    both = users.find().sort("username").populate("posts").populate("postCount").collect()
    assert [(len(u.posts), u.postCount) for u in both] == [(1, 1), (1, 1)]
    totals = posts.aggregate([{"$match": {"likes": {"$gt": 5}}}, {"$group": {"_id": "$author", "total": {"$sum": 1}, "avg": {"$avg": "$likes"}, "tags": {"$push": "$tags"}}}, {"$sort": {"avg": -1}}]).exec()
    assert [(r.total, r.avg, r.tags) for r in totals] == [(1, 15.0, [["tutorial"]]), (1, 10.0, [["tutorial"]])]
    likes = users.aggregate().lookup({"from": "Post", "localField": "_id", "foreignField": "author", "as": "posts"}).project({"username": 1, "n": {"$size": "$posts"}, "likes": {"$sum": "$posts.likes"}}).sort({"likes": -1}).exec()
    assert [(r.n, r.likes) for r in likes] == [(1, 15), (1, 10)]


def test_updates(blog):
    users, _ = blog
    assert users.update_one({"username": "ann"}, {"$inc": {"age": 1}, "$push": {"tags": "new"}})["modifiedCount"] == 1
    ann = users.by_email("ann@x")
    assert (ann.age, ann.tags, ann["__v"]) == (26, ["new"], 1) and ann.updatedAt > ann.createdAt
    assert users.update_many({}, {"$set": {"isActive": False}})["modifiedCount"] == 2 and users.update_many({"age": 99}, {"$set": {"age": 1}})["matchedCount"] == 0
    made = users.update_one({"username": "cat"}, {"$set": {"email": "cat@x", "age": 3}, "$setOnInsert": {"isActive": False}}, upsert=True)
    assert made["upsertedCount"] == 1 and users.find_by_id(made["upsertedId"]).isActive is False
    assert users.find_one_and_update({"username": "bob"}, {"age": 31}).age == 30 and users.find_one_and_update({"username": "bob"}, {"age": 32}, new=True).age == 32
    assert users.replace_one({"username": "bob"}, {"username": "rob", "email": "r@x", "age": 1})["modifiedCount"] == 1
    rob = users.find_one({"username": "rob"})
    assert rob.tags == [] and users.find_one({"username": "bob"}) is None and rob.lastLogin is None
    assert users.increment({"username": "rob"}, "age", 5) == 1 and users.find_one({"username": "rob"}).age == 6
    done = users.bulk_write([{"insertOne": {"document": {"username": "n", "email": "n@n", "age": 4}}}, {"updateOne": {"filter": {"username": "n"}, "update": {"$set": {"age": 9}}}}, {"deleteOne": {"filter": {"username": "n"}}}, {"updateOne": {"filter": {"username": "u"}, "update": {"$set": {"email": "@", "age": 2}}, "upsert": True}}])
    assert (done["nInserted"], done["nModified"], done["nRemoved"], done["nUpserted"]) == (1, 1, 1, 1)
    assert users.find_one_and_delete({"username": "u"}).username == "u" and users.delete_many({"age": {"$lt": 7}}) == 2 and users.count_documents() == 1


def test_bulk_writes_are_one_snapshot(db, spark):
    model = db.model("bulk", {"k": {"type": "Integer", "unique": True}, "v": {"type": "Integer", "default": 0}})
    model.insert_frame(spark.createDataFrame([(f"i{i}", i) for i in range(6)], "_id string, k int"))
    before, reader = model.store.version(), model.df()
    done = model.bulk_write([
        {"insertOne": {"document": {"_id": "n", "k": 9}}}, {"updateOne": {"filter": {"k": {"$gte": 4}}, "update": {"$set": {"v": 5}}}}, {"updateMany": {"filter": {"v": 5}, "update": {"$inc": {"v": 1}}}},
        {"deleteOne": {"filter": {"k": 0}}}, {"deleteMany": {"filter": {"k": {"$in": [1, 2]}}}}, {"replaceOne": {"filter": {"k": 9}, "replacement": {"k": 10, "v": 3}}}, {"updateOne": {"filter": {"k": 77}, "update": {"$set": {"v": 1}}, "upsert": True}},
    ])
    assert done == {"nInserted": 1, "nMatched": 3, "nModified": 3, "nUpserted": 1, "nRemoved": 3}
    assert model.store.version() == before + 1
    assert sorted((r.k, r.v) for r in model.df().collect()) == [(3, 0), (4, 6), (5, 0), (10, 3), (77, 1)]
    assert reader.count() == 6  # the frame from before still reads its snapshot
    folders = [x["name"] for x in model.store.files.list(model.store.path) if x["folder"]]
    kept = {p for m in model.store._manifests() for p in model.store.manifest(int(m[:-5]))["parts"]}
    assert set(folders) == kept
    with pytest.raises(papyra.ValidationError):
        model.bulk_write([{"insertOne": {"document": {"k": 100}}}, {"insertOne": {"document": {"k": 100}}}])
    assert model.count({"k": 100}) == 1


def test_frames_keep_unique_fields(db, spark):
    model = db.model("u", {"name": {"type": "String", "unique": True}})
    model.insert_frame(spark.createDataFrame([("1", "a"), ("2", None), ("3", None)], "_id string, name string"))
    for rows in ([("1", "b")], [("9", "a")], [("9", "z"), ("8", "z")], [("9", "y"), ("9", "x")]):
        with pytest.raises(papyra.ValidationError, match="duplicate"):
            model.insert_frame(spark.createDataFrame(rows, "_id string, name string"))
    assert model.df().count() == 3


def test_a_batch_is_appended_once(db, spark):
    model = db.model("s", {"k": {"type": "Integer"}})
    rows = spark.createDataFrame([("1", 1)], "_id string, k int")
    model.insert_frame(rows, batch=("q", 0))
    model.insert_frame(rows, batch=("q", 0))
    assert model.df().count() == 1
    model.update_many({}, {"$inc": {"k": 1}})
    model.insert_frame(rows, batch=("q", 0))
    model.insert_frame(spark.createDataFrame([("2", 1)], "_id string, k int"), batch=("q", 1))
    assert sorted((r["_id"], r.k) for r in model.df().collect()) == [("1", 2), ("2", 1)]


def test_small_folders_become_one(db, spark, monkeypatch):
    from papyra.sources import store

    monkeypatch.setattr(store, "MANY", 3)
    model = db.model("c", {"k": {"type": "Integer"}})
    for i in range(5):
        model.insert_frame(spark.createDataFrame([(f"{i}", i)], "_id string, k int"))
    assert len(model.store.manifest()["parts"]) == 3 and sorted(r.k for r in model.df().collect()) == [0, 1, 2, 3, 4]


def test_populate_of_rows_that_share_an_id(spark):
    from papyra.plans.query import populated

    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (None, ["b", "zz", "a"]), (2, None), (3, []), (1, ["a", "b"])], "_id int, refs array<string>")
    out = populated(df, "refs", spark.createDataFrame([("a", 1), ("b", 2)], "_id string, n int"))
    assert sorted((str(r["_id"]), None if r.refs is None else [d.n for d in r.refs]) for r in out.collect() if r.refs is not None) == [("1", [1, 2]), ("1", [1, 2]), ("1", [2]), ("3", []), ("None", [2, 1])]
    assert out.where("refs is null").count() == 1


def test_virtual_populate_chooses_before_it_collects(db, spark):
    users = papyra.Schema({"name": "String"})
    for key, options in {"top": {"sort": {"likes": -1}, "limit": 2}, "best": {"sort": {"likes": -1}, "just_one": True}, "rest": {"sort": {"likes": -1}, "skip": 2}, "liked": {"match": {"likes": {"$gt": 3}}, "count": True}}.items():
        users.virtual(key, {"ref": "posts", "local_field": "_id", "foreign_field": "user", **options})
    model, posts = db.model("users", users), db.model("posts", {"user": "String", "likes": "Integer"})
    model.insert_frame(spark.createDataFrame([("a", "x"), ("b", "y")], "_id string, name string"))
    posts.insert_frame(spark.createDataFrame([(f"p{i}", "a", i % 5) for i in range(7)], "_id string, user string, likes int"))
    rows = {r["_id"]: r for r in model.find().populate("top").populate("best").populate("rest").populate("liked").df().collect()}
    assert [d["_id"] for d in rows["a"].top] == ["p4", "p3"] and rows["a"].best["_id"] == "p4" and [d["_id"] for d in rows["a"].rest] == ["p2", "p1", "p6", "p0", "p5"] and rows["a"].liked == 1
    assert rows["b"].top == [] and rows["b"].best is None and rows["b"].liked == 0


def test_only_folders_with_matches_are_rewritten(db, spark):
    store = db.model("N").store
    for k in range(3):
        store.append(spark.range(k * 10, k * 10 + 10).selectExpr("cast(id as string) as _id", "id as n"))
    before = store.manifest()["parts"]
    assert db["N"].update_many({"n": {"$gte": 10, "$lt": 12}}, {"$inc": {"n": 100}})["modifiedCount"] == 2
    after = store.manifest()["parts"]
    assert len(set(before) & set(after)) == 2 and store.read().count() == 30 and store.read(version=3).where("n > 100").count() == 0
    with pytest.raises(Conflict):
        store._commit({"version": 3}, [], store.schema())


def test_fields_widen(db, spark):
    rows = db.model("W")
    rows.create([{"a": 1}, {"a": 2, "b": {"c": 1}}])
    rows.create({"a": 1.5, "d": [1, 2]})
    assert sorted(r.a for r in rows.df().collect()) == [1.0, 1.5, 2.0] and dict(rows.df().dtypes)["d"] == "array<bigint>"
    rows.update_many({"a": {"$lt": 2}}, {"$set": {"new": "x"}, "$inc": {"a": 0.25}})
    assert rows.find({"new": "x"}).count_documents() == 2


def test_documents(blog):
    users, posts = blog
    doc = users.by_email("ann@x")
    assert not doc.is_modified() and doc.set("age", 40).is_modified("age") and doc.get_changes() == {"age": 40}
    doc.set("profile.bio", "hi")
    doc.save()
    again = users.by_email("ann@x")
    assert (again.age, again.profile["bio"], again["__v"]) == (40, "hi", 1) and again == doc and not doc.is_modified()
    doc.invalidate("age", "no")
    assert isinstance(doc.validate_sync(), papyra.ValidationError)
    fresh = users({"username": "new", "email": "n@x", "age": 2})
    assert fresh.is_new and fresh.isActive is True and fresh.isAdult is False
    assert fresh.save().id and users.count_documents() == 3
    post = posts.find_one({"likes": 10}).populate("author")
    assert post.author.username == "ann" and post.populated("author") == doc.id and post.depopulate().author == doc.id
    plain = again.to_object(virtuals=False, version_key=False, minimize=True)
    assert "lastLogin" not in plain and "__v" not in plain
    assert again.is_default("isActive") and again.clone().equals(again) and again.inc("age").age == 41


def test_hooks_and_plugins(db):
    seen = []
    schema = papyra.Schema({"title": "String", "n": {"type": "Integer", "default": 1}})
    schema.pre("save", lambda d: d.update(title=d["title"].strip()) if isinstance(d, dict) else seen.append("resave")).post("save", lambda d: seen.append(d.title)).pre("validate", lambda d: seen.append("validate"))
    schema.pre("find", lambda q: q.where("n").gt(0)).post("aggregate", lambda d: d)
    schema.plugin(lambda s: s.method("twice", lambda self: self.n * 2))
    model = db.model("H", schema)
    made = model.create({"title": "  x "})
    assert seen == ["validate", "x"] and made.title == "x" and made.twice() == 2
    model.create({"title": "y", "n": -1})
    assert len(model.find().collect()) == 1 and model.count_documents() == 2
    with pytest.raises(ValueError):
        schema.pre("nope", print)


def test_schema_parts(spark):
    schema = papyra.Schema({"a": {"type": "String", "trim": True, "lowercase": True, "minlength": 2, "alias": "first"}, "b": {"type": "Number", "max": 5}, "c": papyra.Schema({"d": {"type": "Boolean", "required": True}}), "e": [{"f": "Integer"}], "g": "Date", "h": {"type": "String", "enum": ["x", "y"]}}, timestamps=False, version_key=False)
    assert schema.struct(bare=True).simpleString() == "struct<a:string,b:double,c:struct<d:boolean>,e:array<struct<f:bigint>>,g:timestamp,h:string>"
    assert schema.pick(["a", "b"]).struct(bare=True).names == ["a", "b"] and schema.omit(["a"]).required_paths() == [] and schema.path("c.d").is_required[0] and schema.path_type("c") == "nested" and schema.is_array("e")
    row = schema.prepared(schema.frame(spark, [{"a": "  AB ", "b": "3.5", "c": {"d": True}, "g": "2024-01-02T03:04:05.000Z", "e": [{"f": 1}]}])).first()
    assert (row.a, row.b, row.g.replace(tzinfo=None), row.c.d) == ("ab", 3.5, dt.datetime(2024, 1, 2, 3, 4, 5), True)
    assert schema.with_virtuals(schema.prepared(schema.frame(spark, [{"a": "zz"}]))).first().first == "zz"
    with pytest.raises(papyra.ValidationError, match="more than 5.*c.d is required.*allowed"):
        schema.check(schema.prepared(schema.frame(spark, [{"a": "long", "b": 6.0, "c": {"d": None}, "h": "z"}])))
    assert schema.to_json_schema()["properties"]["c"] == {"type": "object", "properties": {"d": {"type": "boolean"}}, "required": ["d"]}
    with pytest.raises(TypeError):
        papyra.Schema({"a": "Nope"})
    assert papyra.Schema({"q": "String"}).add(schema).clone().paths().keys() >= {"q", "a"}


def test_files(db, spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"_id": "1", "at": "2024-01-02T03:04:05.678Z", "n": 1, "o": {"p": [1, 2]}}, {"_id": "2", "n": 2.5}]))
    model = db.model("J")
    assert model.import_json(f"{tmp_path}/in.json") == 2
    assert model.find({"_id": "1"}).lean().one()["at"] == dt.datetime(2024, 1, 2, 3, 4, 5, 678000) and model.find({"o.p": {"$in": [2]}}).count_documents() == 1
    model.export_json(f"{tmp_path}/out")
    assert papyra.sources.read_json(spark, f"{tmp_path}/out", lines=True).count() == 2 and papyra.sources.read_json(spark, f"{tmp_path}/none").count() == 0
    path = model.backup()
    assert model.delete_many() == 2 and model.count_documents() == 0
    assert [b["path"].rstrip("/").endswith(path.rpartition("/")[2]) for b in model.list_backups()] == [True] and model.restore() and model.count_documents() == 2
    with pytest.raises(FileNotFoundError):
        model.cleanup_backups("nope")
    assert model.cleanup_backups() == 1
    assert db.list_collections() == ["J"] and db.use_db("other").list_collections() == []
    db.drop_collection("J")
    assert db.list_collections() == []


def test_out_and_merge(blog, db):
    _, posts = blog
    posts.aggregate([{"$match": {"likes": {"$gt": 12}}}, {"$out": "Top"}]).run()
    assert db["Top"].count_documents() == 1
    posts.aggregate([{"$addFields": {"likes": {"$add": ["$likes", 100]}}}, {"$merge": {"into": "Top", "whenMatched": "merge"}}]).run()
    assert sorted(r.likes for r in db["Top"].df().collect()) == [110, 115]
    posts.aggregate([{"$out": "Post"}]).run()  # a collection may be read and written at once
    assert posts.count_documents() == 2


def test_discriminators(db):
    base = db.model("Shape", papyra.Schema({"name": "String"}))
    circle = base.discriminator("Circle", papyra.Schema({"r": "Number"}))
    base.create({"name": "plain"})
    circle.create({"name": "round", "r": 2.0})
    assert circle.count_documents() == 1 and base.count_documents() == 2 and circle.find().one().r == 2.0 and circle.delete_many() == 1 and base.count_documents() == 1


def test_unsupported(db):
    for call in (db.start_session, db.watch, db.model("X").watch, db.model("X").map_reduce, db.model("X").find().cursor):
        with pytest.raises(NotImplementedError):
            call()


def test_small_parts_of_the_interface(spark, db):
    assert Query.sanitize_projection({"a": 1, "b": False, "c": "$x", "d": {"$sum": 1}, "e": 0}) == {"a": 1, "b": 0, "e": 0}
    assert db.set_client(None) is db and db.as_promise() is db
    field = papyra.Schema({"a": {"type": "Integer", "min": 1, "required": True}}).path("a")
    assert [field.validate_all(spark.createDataFrame(rows, "a int")) for rows in ([(1,), (5,)], [(1,), (0,)], [(1,), (None,)])] == [True, False, False]


def test_query_builder(spark):
    q = Query(lambda: spark.range(20).withColumnRenamed("id", "n"))
    assert [r.n for r in q.where("n").gte(3).lte(9).ne(5).mod(2, 1).sort("-n").df().collect()] == [9, 7, 3]
    assert q.find({"n": 3}).clone().get_filter() == {"n": 3} and q.merge(q.find({"n": 4})).count_documents() == 1
    assert q.paginate(2, 5).sort("n").lean().collect()[0] == {"n": 5} and q.limit(0).df().count() == 20
    assert q.hint("broadcast").comment("c").get_options()["comment"] == "c" and q.select("-n").selected_exclusively()
    places = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.2, 0.0]), (4, [80.0, 0.0])], "_id int, at array<double>")
    near = Query(lambda: places).where("at").near({"center": [0.1, 0.0], "maxDistance": 500000})
    assert sorted(r._id for r in near.df().collect()[:2]) == [1, 3] and near.df().collect()[2]._id == 2 and near.max_distance(20000).df().count() == 2
    assert Query(lambda: places).box("at", [-1, -1], [0.5, 1]).count_documents() == 2 and Query(lambda: places).where("at").within({"center": [[0, 0], 0.5]}).count_documents() == 2
    assert Query(lambda: places).where("at").polygon([-1, -1], [2, -1], [2, 1], [-1, 1]).count_documents() == 3 and Query(lambda: places).center_sphere("at", [0, 0], 0.1).count_documents() == 3
    with pytest.raises(ValueError):
        q.gt(1)
    with pytest.raises(AttributeError):
        q.nope()


def test_stream(spark, db, tmp_path):
    spark.range(10).selectExpr("id as n", "array(id, id + 1) as t").write.parquet(f"{tmp_path}/s")
    df = papyra.stream(spark, f"{tmp_path}/s", spark.read.parquet(f"{tmp_path}/s").schema, [{"$match": {"n": {"$gte": 5}}}, {"$unwind": "$t"}, {"$project": {"n": 1, "t": 1}}])
    assert df.isStreaming
    model = db.model("S")
    papyra.stream_into(df, model, f"{tmp_path}/ck").awaitTermination()
    assert model.count_documents() == 10
    with pytest.raises(ValueError):
        papyra.stream(spark, f"{tmp_path}/s", df.schema, [{"$group": {"_id": "$n"}}])
