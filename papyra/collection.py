"""Databases and collections: reads as lazy DataFrames, writes as new snapshots."""

from __future__ import annotations

import datetime as dt
import secrets
import time
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from papyra.document import Document
from papyra.functions.filters import _sure, compile_filter
from papyra.functions.accumulators import pushed
from papyra.functions.paths import Scope, name, resolve
from papyra.functions.updates import compile_update
from papyra.operators.relational import directed, join_key, merged
from papyra.plans.pipeline import Context, Pipeline
from papyra.plans.query import Query, populated
from papyra.schema import Schema, ValidationError
from papyra.session import configure
from papyra.sources.files import Files
from papyra.sources.json_files import read_json, write_json
from papyra.sources.store import Store


def object_id() -> str:
    return f"{int(time.time()):08x}{secrets.token_hex(8)}"


class Database:
    """A folder of collections, and the registry of their schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = configure(spark), root.rstrip("/")
        self.files = Files(spark)
        self.files.make(self.root)
        self.state = 1
        self._models: dict[str, Collection] = {}
        self._config: dict[str, Any] = {}
        self._plugins: list[Callable] = []

    def model(self, name: str, schema: Schema | Mapping[str, Any] | None = None) -> "Collection":
        if schema is not None or name not in self._models:
            schema = Schema(schema) if isinstance(schema, Mapping) else schema
            for plugin, options in self._plugins:
                if schema is not None:
                    schema.plugin(plugin, **options)
            self._models[name] = Collection(self, name, schema)
        return self._models[name]

    def collection(self, name: str) -> "Collection":
        return self._models.get(name) or self.model(name)

    __getitem__ = collection

    def delete_model(self, name: str) -> None:
        self._models.pop(name, None)

    def model_names(self) -> list[str]:
        return list(self._models)

    def list_collections(self) -> list[str]:
        return [x["name"] for x in self.files.list(self.root) if x["folder"] and not x["name"].startswith(("_", ".")) and Store(self.spark, self.root, x["name"]).exists()]

    def drop_collection(self, name: str) -> None:
        Store(self.spark, self.root, name).drop()
        self._models.pop(name, None)

    def use_db(self, name: str) -> "Database":
        return Database(self.spark, f"{self.root.rpartition('/')[0]}/{name}")

    def close(self) -> None:
        self._models.clear()
        self.state = 0

    disconnect = destroy = close

    def drop_database(self) -> None:
        self.files.delete(self.root)
        self.close()

    remove_db = drop_database

    def get(self, key: str) -> Any:
        return self._config.get(key)

    def set(self, key: str, value: Any) -> "Database":
        self._config[key] = value
        return self

    def plugin(self, f: Callable, **options: Any) -> "Database":
        if all(f is not g for g, _ in self._plugins):
            self._plugins.append((f, options))
        return self

    def client(self) -> SparkSession:
        return self.spark

    get_client = client

    def set_client(self, _: Any = None) -> "Database":
        """The session is the client; there is no other to set."""
        return self

    def as_promise(self) -> "Database":
        """A database is open once it is made; nothing is waited for."""
        return self

    def sync_indexes(self) -> None:
        """Indexes are metadata; there is nothing to synchronise."""

    def start_session(self, *_: Any) -> None:
        raise NotImplementedError("transactions are not supported")

    transaction = with_session = start_session

    def watch(self, *_: Any) -> None:
        raise NotImplementedError("change streams are not supported")


def connect(spark: SparkSession, root: str) -> Database:
    return Database(spark, root)


create_connection = connect


class Collection:
    """CRUD over one collection. Reads are plans; each write makes one new snapshot (see papyra.sources.store)."""

    def __init__(self, database: Database, name: str, schema: Schema | None = None):
        self.database, self.name, self.schema, self.spark = database, name, schema, database.spark
        self.store = Store(database.spark, database.root, name)
        self._indexes: dict[str, dict] = {}

    def __getattr__(self, key: str) -> Any:
        schema = self.__dict__.get("schema")
        if schema is not None and key in schema.statics:
            return lambda *args, **kw: schema.statics[key](self, *args, **kw)
        raise AttributeError(key)

    def __call__(self, values: Mapping[str, Any] | None = None) -> Document:
        return Document(values, self)

    new = __call__

    @property
    def text_fields(self) -> list[str] | None:
        return (self.schema.text_fields() or None) if self.schema else None

    def hydrate(self, row: Mapping[str, Any]) -> Document:
        return Document(row, self, is_new=False)

    def hooks(self, when: str, event: str, value: Any) -> Any:
        """Hooks of reads take and return a Query or DataFrame; one that returns None leaves it as it is."""
        for hook in ((self.schema.pres if when == "pre" else self.schema.posts).get(event, []) if self.schema else ()):
            out = hook(value)
            value = value if out is None else out
        return value

    # Reads.
    def df(self, version: int | None = None) -> DataFrame:
        empty = self.schema.struct() if self.schema else T.StructType([T.StructField("_id", T.StringType())])
        return self.store.read(empty, version)

    def find(self, conditions: Mapping[str, Any] | None = None) -> Query:
        return Query(self.df, self, conditions)

    def where(self, path: str, value: Any = ...) -> Query:
        return self.find().where(path, value)

    def find_one(self, conditions: Mapping[str, Any] | None = None) -> Document | None:
        return self.find(conditions).one()

    def find_by_id(self, key: str) -> Document | None:
        return self.find({"_id": key}).one()

    def count_documents(self, conditions: Mapping[str, Any] | None = None) -> int:
        return self.find(conditions).count_documents()

    count = count_documents

    def estimated_document_count(self) -> int:
        return self.df().count()

    def exists(self, conditions: Mapping[str, Any]) -> bool:
        return not self.find(conditions).matched().limit(1).isEmpty()

    def distinct(self, path: str, conditions: Mapping[str, Any] | None = None) -> list:
        return [r[0] for r in self.find(conditions).distinct(path).collect()]

    def context(self) -> Context:
        def find(key: str) -> DataFrame | None:
            return self.database.collection(key).store.read()

        return Context(self.spark, find, lambda key, df: self.database.collection(key).store.overwrite(df), self.text_fields)

    def aggregate(self, pipeline: Iterable[Mapping[str, Any]] = ()) -> Pipeline:
        return Pipeline(self.hooks("pre", "aggregate", self.df()), self.context(), tuple(pipeline))

    def map_reduce(self, *_: Any) -> None:
        raise NotImplementedError("mapReduce is not supported; use aggregate")

    def watch(self, *_: Any) -> None:
        raise NotImplementedError("change streams are not supported; see papyra.streaming")

    start_session = watch

    def populated(self, df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
        path, select = spec["path"], spec.get("select")
        fields = select.split() if isinstance(select, str) else select
        virtual = self.schema.virtuals.get(path) if self.schema else None
        if virtual is not None and virtual.populates:
            return self._virtual(df, path, {**virtual.options, **{k: v for k, v in spec.items() if k in ("match", "limit", "skip", "sort")}})
        field = self.schema.path(path) if self.schema else None
        ref = spec.get("model") or (field.options.get("ref") if field else None)
        if ref is None:
            raise ValueError(f"{path} has no ref")
        other = self.database.collection(ref)
        rows = other.df()
        if spec.get("match"):
            rows = rows.where(compile_filter(spec["match"], Scope(rows)))
        return populated(df, path, rows, fields)

    def _virtual(self, df: DataFrame, path: str, options: Mapping[str, Any]) -> DataFrame:
        """A virtual reference: the documents of ref whose foreign_field is this document's local_field.

        What a match leaves out never joins; of the rest those that skip and limit leave over are chosen, by sort (_id
        breaks ties), before they are collected.
        """
        other = self.database.collection(options["ref"])
        key, rows = options["foreign_field"], other.df()
        if options.get("match"):
            rows = rows.where(compile_filter(options["match"], Scope(rows)))
        if options.get("count"):
            rows = rows.select("_id", *([name(key)] if key != "_id" else []))
        ways = list({**dict(options.get("sort") or {}), "_id": 1}.items())
        skip, limit = options.get("skip", 0), 1 if options.get("just_one") else options.get("limit")
        scope, shown = Scope(rows), rows.columns
        rows = rows.withColumns({f"__order{i}": scope.path(k) for i, (k, _) in enumerate(ways)})
        hidden = [(f"__order{i}", way) for i, (_, way) in enumerate(ways)]
        if skip or limit is not None:
            rank = F.row_number().over(W.partitionBy(name(key)).orderBy(*directed(hidden)))
            last = skip + limit if limit is not None else 2**31 - 1
            rows = rows.withColumn("__rank", rank).where((F.col("__rank") > skip) & (F.col("__rank") <= last)).drop("__rank")
        fk, fkind = resolve(key, rows.schema)
        lk, lkind = resolve(options["local_field"], df.schema)
        rows = rows.withColumn("__fk", join_key(fk, fkind, lkind)).where("__fk is not null")
        document = F.struct(*(name(c) for c in shown))
        found = F.count(F.lit(1)).cast("int") if options.get("count") else pushed(document, hidden, Scope(rows))
        found = rows.groupBy("__fk").agg(found.alias("__found"))
        out = df.withColumn("__lk", join_key(lk, lkind, fkind)).join(found, F.col("__lk") == F.col("__fk"), "left")
        if options.get("count"):
            held = F.coalesce("__found", F.lit(0))
        else:
            held = F.coalesce("__found", F.array().cast(found.schema["__found"].dataType))
        return out.withColumn(path, F.get(held, 0) if options.get("just_one") else held).drop("__lk", "__fk", "__found")

    # Inserts.
    def create(self, docs: Mapping[str, Any] | list | None = None, *more: Mapping[str, Any]) -> Any:
        """One document, or a list of them in one batch: defaults, hooks, validation, one append."""
        many = isinstance(docs, list) or bool(more)
        given = [*(docs if isinstance(docs, list) else [docs or {}]), *more]
        made = self._insert([d._plain() if isinstance(d, Document) else dict(d) for d in given])
        return made if many else made[0]

    def _insert(self, docs: list[dict[str, Any]]) -> list[Document]:
        if not docs:
            return []
        schema = self.schema or Schema()
        docs = [{**schema.defaults(d), "_id": str(d["_id"]) if d.get("_id") is not None else object_id()} for d in docs]
        for event in ("validate", "save"):
            for d in docs:
                for hook in schema.pres.get(event, []):
                    hook(d)
            if event == "validate":
                now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
                schema.check(schema.prepared(schema.frame(self.spark, docs), now))
                for d in docs:
                    for hook in schema.posts.get(event, []):
                        hook(d)
        rows = schema.prepared(schema.frame(self.spark, docs), now)
        self._unique(rows)
        held = {r["_id"]: r.asDict(recursive=True) for r in rows.collect()}  # what was given by the caller's own list
        self.store.append(rows)
        out = [self.hydrate(held[d["_id"]]) for d in docs]
        for d in out:
            for hook in schema.posts.get("save", []):
                hook(d)
        return out

    def _unique(self, rows: DataFrame) -> None:
        """Unique indexes (and _id) hold within new rows and against stored ones."""
        keys = [["_id"], *(self.schema.unique_fields() if self.schema else [])]
        old = self.store.read()
        for key in keys:
            columns = [name(k) for k in key]
            present = reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))
            new = rows.where(present).select(*columns)
            twice = not new.groupBy(*columns).count().where("count > 1").isEmpty()
            if twice or (old is not None and set(key) <= set(old.columns) and not old.select(*columns).join(new, key, "left_semi").isEmpty()):
                raise ValidationError(f"duplicate {', '.join(key)}")

    def insert_many(self, docs: list[Mapping[str, Any]], ordered: bool = True, lean: bool = False) -> list:
        """One batch; ordered: the first invalid document stops all, else invalid ones are left out."""
        if not ordered and self.schema:
            good = []
            for d in docs:
                try:
                    self.schema.check(self.schema.prepared(self.schema.frame(self.spark, [self.schema.defaults(d)])))
                    good.append(d)
                except ValidationError:
                    continue
            docs = good
        made = self._insert([dict(d) for d in docs])
        return [d.to_object() for d in made] if lean else made

    def insert_one(self, doc: Mapping[str, Any]) -> Document:
        return self.create(doc)

    def bulk_save(self, docs: list[Any], ordered: bool = True) -> list:
        return self.create([d._plain() if isinstance(d, Document) else d for d in docs])

    def insert_frame(self, df: DataFrame, check: bool = True, batch: tuple[str, int] | None = None) -> None:
        """Append a DataFrame of any size: casts, defaults, validation and unique fields as plans; hooks don't run.

        batch: a stream's name and a batch's number; a batch that was appended before is left out.
        """
        if batch and self.store.seen(*batch):
            return
        schema = self.schema or Schema()
        rows = schema.prepared(df)
        if check:
            schema.check(rows)
            self._unique(rows)
        self.store.append(rows, batch)

    # Updates.
    def _matched(self, conditions: Mapping[str, Any] | None, df: DataFrame) -> Column:
        return _sure(compile_filter(conditions or {}, Scope(df, self.text_fields)))

    def _first_id(self, conditions: Mapping[str, Any] | None, sort: Any = None) -> str | None:
        """The id of the first match, in order of sort and _id."""
        query = self.find(conditions).sort(sort or {"_id": 1})
        keys = [Scope(query.matched()).path(k) for k in query._order]
        row = query.matched().orderBy(*(c.asc_nulls_first() if way == 1 else c.desc_nulls_last() for c, way in zip(keys, query._order.values(), strict=True)), name("_id").asc_nulls_first()).select("_id").first()
        return row and row["_id"]

    def _changed(self, df: DataFrame, matched: Column, update: Mapping[str, Any]) -> DataFrame:
        changes = compile_update(update, Scope(df))
        changes.pop("_id", None)
        if "__v" in df.columns and "__v" not in changes:
            changes["__v"] = (F.coalesce(name("__v"), F.lit(0)) + 1).cast(df.schema["__v"].dataType)
        if "updatedAt" in df.columns and "updatedAt" not in changes:
            changes["updatedAt"] = F.current_timestamp()
        flagged = df.withColumn("_hit", matched)
        return flagged.withColumns({k: F.when(F.col("_hit"), v).otherwise(name(k) if k in df.columns else F.lit(None)) for k, v in changes.items()}).drop("_hit")

    def _update(self, conditions: Mapping[str, Any], update: Mapping[str, Any]) -> int:
        df = self.df()
        matched = self._matched(conditions, df)
        return self.store.rewrite(matched, lambda rows: self._changed(rows, matched, update))

    def _upsert(self, conditions: Mapping[str, Any] | None, update: Mapping[str, Any]) -> Document:
        """A new document of the filter's equalities and the update, $setOnInsert included."""
        seed = {k: v["$eq"] if isinstance(v, Mapping) and "$eq" in v else v for k, v in (conditions or {}).items() if not k.startswith("$") and not (isinstance(v, Mapping) and any(o.startswith("$") for o in v) and "$eq" not in v)}
        schema = self.schema or Schema()
        base = schema.frame(self.spark, [{"_id": object_id(), **seed}])
        known = schema.struct()
        base = base.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in known.fields if f.name not in base.columns))
        rows = base.withColumns(compile_update(update, Scope(base), insert=True))
        doc = {k: v for k, v in rows.first().asDict(recursive=True).items() if v is not None}
        doc.pop("__v", None)
        return self._insert([doc])[0]

    def update_one(self, conditions: Mapping[str, Any] | None, update: Mapping[str, Any], upsert: bool = False, **_: Any) -> dict[str, Any]:
        key = self._first_id(conditions)
        if key is None:
            made = self._upsert(conditions, update) if upsert else None
            return {"matchedCount": 0, "modifiedCount": 0, "upsertedCount": int(made is not None), "upsertedId": made.id if made else None}
        n = self._update({"_id": key}, update)
        return {"matchedCount": n, "modifiedCount": n, "upsertedCount": 0, "upsertedId": None}

    def update_many(self, conditions: Mapping[str, Any] | None, update: Mapping[str, Any], upsert: bool = False, **_: Any) -> dict[str, Any]:
        n = self._update(conditions or {}, update)
        made = self._upsert(conditions, update) if not n and upsert else None
        return {"matchedCount": n, "modifiedCount": n, "upsertedCount": int(made is not None), "upsertedId": made.id if made else None}

    update = update_many

    def replace_one(self, conditions: Mapping[str, Any] | None, doc: Mapping[str, Any], upsert: bool = False, **_: Any) -> dict[str, Any]:
        """All fields but _id and createdAt give way to doc's."""
        key = self._first_id(conditions)
        if key is None:
            made = self._insert([dict(doc)])[0] if upsert else None
            return {"matchedCount": 0, "modifiedCount": 0, "upsertedCount": int(made is not None), "upsertedId": made.id if made else None}
        old = [f for f in self.df().columns if f not in ("_id", "createdAt", "updatedAt", "__v")]
        new = {k: v for k, v in doc.items() if k != "_id"}
        if self.schema:
            new = {k: v for k, v in self.schema.defaults(new).items()}
            self.schema.check(self.schema.prepared(self.schema.frame(self.spark, [new])))
        n = self._update({"_id": key}, {"$unset": {f: 1 for f in old if f not in new}, "$set": new})
        return {"matchedCount": n, "modifiedCount": n, "upsertedCount": 0, "upsertedId": None}

    def find_one_and_update(self, conditions: Mapping[str, Any] | None, update: Mapping[str, Any], new: bool = False, upsert: bool = False, sort: Any = None, **_: Any) -> Document | None:
        """The document as it was, or with new as it is now."""
        key = self._first_id(conditions, sort)
        if key is None:
            made = self._upsert(conditions, update) if upsert else None
            return made if new else None
        before = self.find_by_id(key)
        self._update({"_id": key}, update)
        return self.find_by_id(key) if new else before

    def find_by_id_and_update(self, key: str, update: Mapping[str, Any], **options: Any) -> Document | None:
        return self.find_one_and_update({"_id": key}, update, **options)

    def find_one_and_replace(self, conditions: Mapping[str, Any] | None, doc: Mapping[str, Any], new: bool = False, upsert: bool = False, **_: Any) -> Document | None:
        key = self._first_id(conditions)
        before = self.find_by_id(key) if key is not None else None
        done = self.replace_one({"_id": key} if key is not None else conditions, doc, upsert)
        return self.find_by_id(key or done["upsertedId"]) if new and (key or done["upsertedId"]) else before

    def increment(self, conditions: Mapping[str, Any], field: str, amount: float = 1) -> int:
        return self._update(conditions, {"$inc": {field: amount}})

    # Deletes.
    def delete_many(self, conditions: Mapping[str, Any] | None = None) -> int:
        self.hooks("pre", "deleteMany", conditions)
        n = self._delete(conditions)
        self.hooks("post", "deleteMany", n)
        return n

    remove = delete_many

    def _delete(self, conditions: Mapping[str, Any] | None) -> int:
        matched = self._matched(conditions, self.df())
        return self.store.rewrite(matched, lambda rows: rows.where(~matched))

    def delete_one(self, conditions: Mapping[str, Any] | None = None) -> int:
        self.hooks("pre", "deleteOne", conditions)
        key = self._first_id(conditions)
        n = 0 if key is None else self._delete({"_id": key})
        self.hooks("post", "deleteOne", n)
        return n

    def find_one_and_delete(self, conditions: Mapping[str, Any] | None = None, sort: Any = None) -> Document | None:
        key = self._first_id(conditions, sort)
        if key is None:
            return None
        found = self.find_by_id(key)
        self._delete({"_id": key})
        return found

    def find_by_id_and_delete(self, key: str) -> Document | None:
        return self.find_one_and_delete({"_id": key})

    find_by_id_and_remove = find_by_id_and_delete

    def bulk_write(self, operations: list[Mapping[str, Any]], ordered: bool = True) -> dict[str, int]:
        """insertOne, updateOne, updateMany, replaceOne, deleteOne, deleteMany, one after the other; one snapshot for all."""
        with self.store.batch():
            return self._bulk(operations, ordered)

    def _bulk(self, operations: list[Mapping[str, Any]], ordered: bool) -> dict[str, int]:
        out = {"nInserted": 0, "nMatched": 0, "nModified": 0, "nUpserted": 0, "nRemoved": 0}
        errors: list[Exception] = []
        for operation in operations:
            ((op, x),) = operation.items()
            try:
                if op == "insertOne":
                    self.create(x["document"])
                    out["nInserted"] += 1
                elif op in ("updateOne", "updateMany", "replaceOne"):
                    write = {"updateOne": self.update_one, "updateMany": self.update_many, "replaceOne": self.replace_one}[op]
                    done = write(x.get("filter"), x["replacement"] if op == "replaceOne" else x["update"], upsert=x.get("upsert", False))
                    out["nMatched"] += done["matchedCount"]
                    out["nModified"] += done["modifiedCount"]
                    out["nUpserted"] += done["upsertedCount"]
                elif op in ("deleteOne", "deleteMany"):
                    out["nRemoved"] += (self.delete_one if op == "deleteOne" else self.delete_many)(x.get("filter"))
                else:
                    raise ValueError(f"unknown bulk operation {op}")
            except ValidationError as e:
                if ordered:
                    raise
                errors.append(e)
        return out | ({"errors": len(errors)} if errors else {})

    def merge_frame(self, df: DataFrame, on: str = "_id", matched: str = "merge", missing: str = "insert") -> None:
        """Upsert a DataFrame by a key."""
        old = self.store.read()
        self.store.overwrite(df if old is None else merged(old, df, on, matched, missing))

    # Values as the schema has them.
    def cast_object(self, doc: Mapping[str, Any]) -> dict[str, Any]:
        row = self.schema.prepared(self.schema.frame(self.spark, [dict(doc)])).first().asDict(recursive=True)
        return {k: v for k, v in row.items() if k in doc}

    def apply_defaults(self, doc: Mapping[str, Any]) -> dict[str, Any]:
        return self.schema.defaults(doc)

    def apply_timestamps(self, doc: Mapping[str, Any]) -> dict[str, Any]:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return {**doc, "createdAt": doc.get("createdAt") or now, "updatedAt": now}

    def apply_virtuals(self, df: DataFrame) -> DataFrame:
        return self.schema.with_virtuals(df)

    def translate_aliases(self, conditions: Mapping[str, Any]) -> dict[str, Any]:
        return {self.schema.aliases.get(k, k): v for k, v in conditions.items()}

    def validate(self, doc: Mapping[str, Any]) -> None:
        self.schema.check(self.schema.prepared(self.schema.frame(self.spark, [dict(doc)])))

    def discriminator(self, key: str, schema: Schema) -> "Discriminated":
        """A model of the same collection whose documents carry _type = key."""
        merged_schema = self.schema.discriminator(key, schema).clone().add({"_type": {"type": "String", "default": key}})
        return Discriminated(self.database, self.name, merged_schema, key)

    # Management.
    def create_collection(self) -> "Collection":
        if not self.store.exists():
            self.store.append(self.df())
        return self

    init = create_collection

    def recompile_schema(self) -> None:
        """Schemas are compiled with each plan; there is nothing to do."""

    @property
    def namespace(self) -> str:
        return f"{self.database.root}/{self.name}"

    def inspect(self) -> str:
        return f"Collection({self.name})"

    __repr__ = inspect

    def drop(self) -> None:
        self.store.drop()

    def import_json(self, path: str, lines: bool = False) -> int:
        """Append a JSON array (or lines) of documents of any size, with ids for those that have none."""
        df = read_json(self.spark, path, lines=lines)
        self.insert_frame(df)
        return df.count()

    def export_json(self, path: str) -> None:
        write_json(self.df(), path)

    def backup(self) -> str:
        return self.store.backup()

    def restore(self, path: str | None = None) -> str:
        return self.store.restore(path)

    def list_backups(self) -> list[dict]:
        return self.store.backups()

    def cleanup_backups(self, filename: str | None = None) -> int:
        return self.store.clean_backups(filename)

    # Indexes: metadata only.
    def create_indexes(self) -> dict[str, dict]:
        for fields, options in self.schema.indexes() if self.schema else ():
            self.ensure_index(fields, **options)
        return self.list_indexes()

    ensure_indexes = sync_indexes = create_indexes

    def ensure_index(self, fields: Mapping[str, Any], **options: Any) -> str:
        key = options.get("name") or "_".join(f"{k}_{v}" for k, v in fields.items())
        self._indexes[key] = {"fields": dict(fields), **options}
        return key

    create_search_index = ensure_index

    def list_indexes(self) -> dict[str, dict]:
        return dict(self._indexes)

    list_search_indexes = list_indexes

    def drop_index(self, key: str) -> None:
        if key not in self._indexes:
            raise KeyError(key)
        del self._indexes[key]

    drop_search_index = drop_index

    def update_search_index(self, key: str, **options: Any) -> None:
        self._indexes[key].update(options)

    def clean_indexes(self) -> None:
        self._indexes.clear()

    def diff_indexes(self) -> dict[str, list]:
        declared = {"_".join(f"{k}_{v}" for k, v in fields.items()) for fields, _ in (self.schema.indexes() if self.schema else ())}
        return {"toCreate": sorted(declared - set(self._indexes)), "toDrop": sorted(set(self._indexes) - declared)}


class Discriminated(Collection):
    def __init__(self, database: Database, name: str, schema: Schema, key: str):
        super().__init__(database, name, schema)
        self.key = key

    def df(self, version: int | None = None) -> DataFrame:
        df = super().df(version)
        return df.where(F.col("_type") == self.key) if "_type" in df.columns else df.limit(0)

    def _matched(self, conditions: Mapping[str, Any] | None, df: DataFrame) -> Column:
        return super()._matched(conditions, df) & _sure(F.col("_type") == self.key)
