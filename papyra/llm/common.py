"""Shared pieces of the training-data operators: text normalisation, checkpoints, skew-safe joins."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key is hot when it holds more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys:
#: that is the proven bound under which hot keys are broadcast.
HOT_SHARE = 1000


#: Rows that Python workers get at once, unless the session has a setting of its own: texts may be long.
BATCH_ROWS = "1000"
_shipped: set[str] = set()
_held: dict[Any, Any] = {}


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next. Workers serve several operators; only one's cache stays."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (where PYTHONPATH or the working folder don't do so, as an added zip), and
    keep the batches that they get small."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    near = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if sc.applicationId in _shipped or any(x and Path(x).resolve() == root for x in near):
        return
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/papyra", "zip", root, "papyra"))
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure-ASCII texts take Spark's byte-wise ``lower``; others are translated."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id's text mod k; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir, which all executors share.

    Only where that setting is absent is one chosen here: a temporary one on a local master, one under the (shared)
    warehouse otherwise.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            named = tempfile.mkdtemp(prefix="papyra-ckpt-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


#: Folders of tables written in the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """df, and those of more after it, written as one Parquet table in the shared folder and read again: it survives lost
    executors, and its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for other in more:
        other.write.mode("append").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables between the steps of an operator. Unlike Spark's checkpoints, they don't inherit the estimated size of their plan,
#: which joins multiply, over rounds of joins to numbers of millions of digits with which the planner never ends.
checkpoint = written


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written inside are removed at the end, but for those that the frames given to the yielded function read."""
    held: list[str] = []
    kept: set[str] = set()

    def keep(*frames: DataFrame) -> None:
        for f in frames:
            kept.update(x for x in held if any(f"/{x.rpartition('/')[2]}/" in file for file in f.inputFiles()))

    _scopes.append(held)
    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1] += [x for x in held if x in kept]
        remove(spark, (x for x in held if x not in kept))


#: Most ids of dropped rows that are broadcast (some 32 bytes each); beyond, the same join shuffles.
BROADCAST_IDS = 1_000_000


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart where ids repeat; ordered as the ids are."""
    return F.struct(doc_id.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like name that isn't taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """docs but the rows whose key is in dropped (column _dropped); texts move only if more than BROADCAST_IDS rows go.

    Rows that repeat both id and text stay or go together.
    """
    dropped = checkpoint(dropped.select(F.col("_dropped.id").alias("_dropped_id"), F.col("_dropped.hash").alias("_dropped_hash")).distinct())
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, key["id"].eqNullSafe(dropped["_dropped_id"]) & (key["hash"] == dropped["_dropped_hash"]), "left_anti")


def skew_safe_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with table (unique by key; column size: the rows that hold the key) without hot tasks.

    Keys with more than total / HOT_SHARE rows number under HOT_SHARE, so they are broadcast and their rows never
    shuffle; every other key has few rows and is joined by shuffle. rows and table should be checkpointed.
    """
    limit = total / HOT_SHARE
    hot = F.broadcast(table.where(F.col(size) > limit))
    cold = table.where(F.col(size) <= limit)
    return rows.join(hot, key, "inner").unionByName(rows.join(F.broadcast(table.where(F.col(size) > limit).select(key)), key, "left_anti").join(cold, key, "left"))


#: Characters of text that a classifier is fitted on, at most; what bounds the driver's memory where texts are long.
SAMPLE_CHARS = 100_000_000
#: Texts of more characters come after all others in the sample, so that a few long ones don't crowd out the rest.
SAMPLE_LONG = 100_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", chars: int = SAMPLE_CHARS, long: int = SAMPLE_LONG) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents outside fold 0, the first by a hash of their id, and of
    these as many as come to ``chars`` characters, those longer than ``long`` last.

    The bounds make the sample safe to collect. Texts that the bound on characters leaves out are warned of; if it
    leaves out a label's every text, ValueError is raised. Null ids and labels are left out; of an id's texts, and of a
    text's copies, one remains.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col)) != 0))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    # Of rows that repeat an id one text stays, which tasks find out before anything moves; so at most `rows` are in this window.
    found = found.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text"))
    total = F.sum(F.length("_text")).over(W.orderBy(F.length("_text") > long, F.xxhash64("_id"), "_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = found.withColumn("_total", total).select("_id", "_y", F.when(F.col("_total") <= chars, F.col("_text")).alias("_text")).collect()
    held = [r for r in found if r._text is not None]
    if len(held) < len(found):
        if lost := {r._y for r in found} - {r._y for r in held}:
            raise ValueError(f"no text with {label} {sorted(lost)} fits the sample's {chars} characters")
        warnings.warn(f"{len(found) - len(held)} of {len(found)} texts with {label} don't fit the sample's {chars} characters", stacklevel=2)
    unique = {r._text: r._y for r in sorted(held, key=lambda r: r._id)}
    return list(unique), list(unique.values())


def logistic(x, y, l2: float = 1e-3, rounds: int = 50):
    """Weights of a small logistic regression (a column of ones included in x), by Newton's method."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + l2 * len(x) * np.eye(len(w)) * 0.01 + 1e-9 * np.eye(len(w)), x.T @ (y - p) - l2 * len(x) * 0.01 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
