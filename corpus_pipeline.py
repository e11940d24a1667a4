"""A training corpus from documents: quality, exact and near dedup, decontamination, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bpe import round_trip
from papyra.llm.common import read, remove, row_key, scratch, without, written
from papyra.llm.decontaminate import WINDOW, contamination, is_contaminated
from papyra.llm.exact_dedup import exact_dedup
from papyra.llm.near_dedup import near_dedup
from papyra.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field calls good."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    key = row_key(F.col("doc_id"), F.col("text"))
    found = exact_dedup(docs.select(key.alias("doc_id"), "text"))
    return without(docs, found.where("not kept").select(F.col("doc_id").alias("_dropped")), key)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the one with the smallest doc_id."""
    key = row_key(F.col("doc_id"), F.col("text"))
    found = near_dedup(docs.select(key.alias("doc_id"), "text"), n=5)
    return without(docs, found.where("not kept").select(F.col("doc_id").alias("_dropped")), key)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of benchmark words, of which shorter items cover less than a twentieth."""
    key = row_key(F.col("doc_id"), F.col("text"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return without(docs, found.where(is_contaminated() | (F.col("longest") >= WINDOW)).select(F.col("_id").alias("_dropped")), key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", tokens)]

#: The quality stage is a fitted model; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes when the next one stands, and what a stage wrote for itself when its own does."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir))
            keep(docs)
        remove(spark, before)
        before = [file.rpartition("/")[0] for file in docs.inputFiles()[:1]]
    return STAGES[-1][1](spark, docs, sf_dir)
