"""Collections as manifests of Parquet folders, with snapshot reads and optimistic writes.

A collection's folder holds data folders (never changed once written) and manifests 00000001.json, 00000002.json, ...:
the schema and the list of data folders of one snapshot. The highest manifest is the current one. A write adds data
folders and then creates the next manifest, which only one writer can do; the other gets a Conflict. An append rewrites
nothing; an update rewrites only the data folders that hold matching rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.sources.files import Files
from papyra.types import merge

#: Snapshots that stay readable.
KEEP = 5
#: An append makes one folder of those below SMALL_BYTES once there are MANY of them.
MANY, SMALL_BYTES = 64, 32 << 20
BACKUPS = "_backups"


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.path = f"{self.root}/{name}"
        self.files = Files(spark)
        self._staged: dict | None = None

    def _manifests(self) -> list[str]:
        return [x["name"] for x in self.files.list(self.path) if x["name"].endswith(".json") and x["name"][:-5].isdigit()]

    def version(self) -> int:
        names = self._manifests()
        return int(names[-1][:-5]) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        if version is None and self._staged is not None:
            return self._staged
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": [], "schema": None}
        return {"version": version, **json.loads(self.files.read(f"{self.path}/{version:08d}.json"))}

    def exists(self) -> bool:
        return self._staged is not None and self._staged["schema"] is not None or bool(self._manifests())

    def schema(self) -> T.StructType | None:
        held = self.manifest()["schema"]
        return T.StructType.fromJson(held) if held else None

    def _of(self, parts: list[str], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts))

    def read(self, default: T.StructType | None = None, version: int | None = None) -> DataFrame | None:
        """The current (or a kept) snapshot; without any, an empty frame of the default schema, or None."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None if default is None else self.spark.createDataFrame([], default)
        return self._of(m["parts"], T.StructType.fromJson(m["schema"]))

    def _commit(self, base: dict, parts: list[str], schema: T.StructType, batches: dict | None = None) -> None:
        """The next snapshot. The folders of a writer that comes too late, or that a batch of writes made in between, go."""
        batches = {**base.get("batches", {}), **(batches or {})}
        if self._staged is not None:
            made = set(base.get("made", ())) | (set(parts) - set(base["parts"]))
            self._staged = {"version": base["version"], "parts": parts, "schema": schema.jsonValue(), "batches": batches, "made": sorted(made)}
            return
        version = base["version"] + 1
        if not self.files.create(f"{self.path}/{version:08d}.json", json.dumps({"parts": parts, "schema": schema.jsonValue(), "batches": batches})):
            for part in set(parts) - set(base.get("parts", ())):
                self.files.delete(f"{self.path}/{part}")
            raise Conflict(f"{self.name}: version {version} was written meanwhile")
        self._clean(version)

    @contextmanager
    def batch(self) -> Iterator[None]:
        """Writes inside see one another and become one snapshot at the end; so also where one of them fails."""
        if self._staged is not None:
            yield
            return
        base = self.manifest()
        self._staged = {**base, "made": []}
        try:
            yield
        finally:
            staged, self._staged = self._staged, None
            if staged["parts"] != base["parts"] or staged["schema"] != base["schema"]:
                self._commit(base, staged["parts"], T.StructType.fromJson(staged["schema"]), staged.get("batches"))
            for part in set(staged["made"]) - set(staged["parts"]):
                self.files.delete(f"{self.path}/{part}")

    def _clean(self, version: int) -> None:
        for name in self._manifests()[:-KEEP]:
            held = set(json.loads(self.files.read(f"{self.path}/{name}"))["parts"])
            self.files.delete(f"{self.path}/{name}")
            for m in self._manifests():
                held -= set(json.loads(self.files.read(f"{self.path}/{m}"))["parts"])
            for part in held:
                self.files.delete(f"{self.path}/{part}")

    def _put(self, df: DataFrame) -> str:
        part = f"p-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def seen(self, source: str, number: int) -> bool:
        """Whether the batch of a stream with that number, or a later one, was appended."""
        return number <= self.manifest().get("batches", {}).get(source, -1)

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """A data folder more; batch: a stream's name and the number of its batch, which is kept with the snapshot."""
        base = self.manifest()
        batches = dict([batch]) if batch else None
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        if base["schema"] is None:
            self._commit(base, [self._put(df)], schema, batches)
            return
        old = T.StructType.fromJson(base["schema"])
        both = merge(old, schema)
        changed = [f.name for f in old.fields if both[f.name].dataType != f.dataType]
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in both.fields))
        if changed:  # a field's type got wider: Parquet files of the old type must follow
            before = self._of(base["parts"], old)
            before = before.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in before.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in both.fields))
            base_parts = [self._put(before)]
        else:
            base_parts = self._compacted(base["parts"], both)
        self._commit(base, [*base_parts, self._put(df)], both, batches)

    def _compacted(self, parts: list[str], schema: T.StructType) -> list[str]:
        if len(parts) < MANY:
            return parts
        small = [p for p in parts if self.files.size(f"{self.path}/{p}") < SMALL_BYTES]
        if len(small) < MANY:
            return parts
        return [*(p for p in parts if p not in set(small)), self._put(self._of(small, schema).coalesce(1 + len(small) * SMALL_BYTES // (256 << 20)))]

    def overwrite(self, df: DataFrame) -> None:
        base = self.manifest()
        self._commit(base, [self._put(df)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))

    def rewrite(self, matched: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Apply change to the data folders that hold rows for which matched is true; the number of such rows.

        change gets all rows of those folders (with the collection's schema) and returns their successors.
        """
        base = self.manifest()
        if base["schema"] is None:
            return 0
        schema = T.StructType.fromJson(base["schema"])
        rows = self._of(base["parts"], schema)
        part = F.regexp_extract(F.input_file_name(), r"/(p-[0-9a-f]{32})/[^/]*$", 1)
        hits = {r.part: r["count"] for r in rows.where(matched).groupBy(part.alias("part")).count().collect()}  # one row per data folder
        if not hits:
            return 0
        new = change(self._of(sorted(hits), schema))
        wider = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema.fields])
        both = merge(schema, wider)
        dropped = [f.name for f in schema.fields if f.name not in wider.names]
        rest = [p for p in base["parts"] if p not in hits]
        if dropped or any(both[f.name].dataType != f.dataType for f in schema.fields):
            self._commit(base, [self._put(change(rows))], wider)
        else:
            self._commit(base, [*rest, self._put(new)], both)
        return sum(hits.values())

    def drop(self) -> None:
        self.files.delete(self.path)

    def backup(self) -> str:
        stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H-%M-%S-%fZ")
        path = f"{self.root}/{BACKUPS}/{self.name}_backup_{stamp}"
        found = self.read()
        if found is None:
            raise FileNotFoundError(f"no collection {self.name}")
        found.write.parquet(path)
        return path

    def backups(self) -> list[dict]:
        """Newest first: filename, path, createdAt, size."""
        found = [x for x in self.files.list(f"{self.root}/{BACKUPS}") if x["name"].startswith(f"{self.name}_backup_")]
        return [{"filename": x["name"], "path": x["path"], "createdAt": dt.datetime.fromtimestamp(x["modified"] / 1000, dt.timezone.utc), "size": self.files.size(x["path"])} for x in reversed(found)]

    def restore(self, path: str | None = None) -> str:
        if path is None:
            known = self.backups()
            if not known:
                raise FileNotFoundError(f"no backup of {self.name}")
            path = known[0]["path"]
        self.overwrite(self.spark.read.parquet(path))
        return path

    def clean_backups(self, filename: str | None = None) -> int:
        known = self.backups()
        chosen = [x for x in known if filename is None or x["filename"] == filename]
        if filename is not None and not chosen:
            raise FileNotFoundError(filename)
        for x in chosen:
            self.files.delete(x["path"])
        return len(chosen)
