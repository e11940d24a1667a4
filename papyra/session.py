"""Session settings that the engine counts on, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one (local master) or one in the warehouse."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="papyra-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: it survives lost executors and starts from the table's own size.

    A checkpoint of Spark's keeps its plan's size estimate, and over rounds of joins (each multiplies the estimates of its
    sides) that grows to numbers with which the planner never ends. Columns of nulls alone aren't written.
    """
    path = f"{shared_folder(df.sparkSession)}/papyra-{uuid.uuid4().hex}"
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    kept = df.drop(*void)
    kept.write.parquet(path)
    held = df.sparkSession.read.schema(kept.schema).parquet(path)
    return held.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns)) if void else held
