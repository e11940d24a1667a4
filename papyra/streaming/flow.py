"""Streams: the pipeline stages that need no state, compiled on a readStream; results go to a collection or a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from papyra.plans.pipeline import Context, check, compile_pipeline

#: Stages that look at one document at a time (lookups join each document with a table that stands still).
STATELESS = ("$match", "$project", "$addFields", "$set", "$unset", "$replaceRoot", "$unwind", "$redact", "$search", "$lookup", "$changeStream")


def stream(spark: SparkSession, path: str, schema: T.StructType, pipeline: Iterable[Mapping[str, Any]] = (), source: str = "parquet", collections: Mapping[str, DataFrame] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of a folder's documents (new files are picked up), through stateless stages."""
    stages = list(pipeline)
    for i, (op, _) in enumerate(check(stages)):
        if op not in STATELESS:
            raise ValueError(f"{op} needs all documents; streams take {', '.join(STATELESS)}")
        if op == "$lookup" and (i + 1 == len(stages) or "$unwind" not in stages[i + 1]):
            raise ValueError("in a stream, $lookup goes with $unwind")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.format(source).load(path)
    return compile_pipeline(df, stages, Context(spark, collections or {}))


def stream_into(df: DataFrame, model: Any, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a collection, a snapshot for each batch; once: what is there now, then stop.

    A batch's number is kept with the snapshot, under the checkpoint's path, so a batch that is run again isn't appended twice.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: None if rows.isEmpty() else model.insert_frame(rows, batch=(checkpoint, n)))
    return (writer.trigger(availableNow=True) if once else writer).start()
