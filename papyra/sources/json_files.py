"""JSON collections: arrays of documents (or a document per line) in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.paths import name
from papyra.sources.files import Files

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z$"


def revived(df: DataFrame) -> DataFrame:
    """Top-level text columns whose values all look like ISO times (ms, Z) as timestamps; one aggregate decides on all."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    row = df.agg(*(F.every(name(c).rlike(ISO)).alias(f"c{i}") for i, c in enumerate(texts))).first()  # nulls are skipped
    return df.withColumns({c: F.to_timestamp(name(c)) for i, c in enumerate(texts) if row[i]})


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Documents of a JSON file or folder. A missing path is an empty collection. With a schema nothing is inferred."""
    if not Files(spark).exists(path):
        return spark.createDataFrame([], schema or T.StructType([T.StructField("_id", T.StringType())]))
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema else revived(reader.json(path))


def write_json(df: DataFrame, path: str) -> None:
    """A folder of files with a document per line; nulls (missing fields) are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)
