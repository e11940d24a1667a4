"""Sharding by extendible hashing; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import checkpoint, read

#: Most bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Bits of the hash, and how many more of them each look at the oversized buckets takes.
BITS, STEP = 60, 4
#: Most directory entries that are broadcast; beyond, the same joins shuffle.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def extendible_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, depth, shard, shard_bytes, shard_docs, fits.

    The directory is indexed by the first bits of a 60-bit hash of the id. Only buckets over shard_bytes split, on
    another bit each time, until every bucket fits; a row's shard is its bucket's bits as a string of 0 and 1 (the
    empty string if nothing splits). A bucket of one hash value that is still too large (a longer text, or rows that
    repeat one id) can't split: it stays one shard, fits = false.

    Null ids hash as the empty text, null texts have no bytes, repeated rows count each; an empty table gives an empty
    result; other columns are ignored. Sizes are partial sums over hash prefixes; texts aren't shuffled.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = checkpoint(df.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), h.alias("_h")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first().b
    # Down to `depth` all buckets are looked at together; from there on only those still oversized.
    above, depth = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / shard_bytes)))) + STEP)
    out, left = None, rows
    while True:
        fine = checkpoint(left.groupBy(F.shiftrightunsigned("_h", BITS - depth).alias("_slot")).agg(F.sum("n_bytes").alias("_b"), F.count(F.lit(1)).alias("_docs"), F.min("_h").alias("_low"), F.max("_h").alias("_high")))
        n_slots = fine.count()
        nodes = fine.select("*", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("_d")).withColumn("_prefix", F.expr(f"shiftrightunsigned(_slot, {depth} - _d)"))
        nodes = checkpoint(nodes.groupBy("_d", "_prefix").agg(F.sum("_b").alias("_bytes"), F.sum("_docs").alias("_n"), F.min("_low").alias("_min"), F.max("_high").alias("_max")))
        # A leaf is the shallowest bucket above a slot that fits or can't be split.
        stop = (F.col("_bytes") <= shard_bytes) | (F.col("_min") == F.col("_max"))
        leaves = fine.select("_slot", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("_d")).withColumn("_prefix", F.expr(f"shiftrightunsigned(_slot, {depth} - _d)"))
        leaves = leaves.join(_small(nodes.where(stop), n_slots * 2), ["_d", "_prefix"]).groupBy("_slot").agg(F.min(F.struct("_d", "_prefix", "_bytes", "_n")).alias("_leaf"))
        leaves = checkpoint(leaves)
        n_leaves = leaves.count()
        placed = left.withColumn("_slot", F.shiftrightunsigned("_h", BITS - depth)).join(_small(leaves, n_leaves), "_slot").select("_id", "n_bytes", "_leaf")
        out = placed if out is None else out.unionByName(placed)
        if n_leaves == n_slots:
            break
        over = fine.join(_small(leaves, n_leaves), "_slot", "left_anti").select("_slot")
        left = checkpoint(left.withColumn("_slot", F.shiftrightunsigned("_h", BITS - depth)).join(_small(over, n_slots - n_leaves), "_slot", "left_semi").drop("_slot"))
        above, depth = depth + 1, min(BITS, depth + STEP)
    bits = F.when(F.col("_leaf._d") == 0, "").otherwise(F.lpad(F.bin("_leaf._prefix"), F.col("_leaf._d"), F.lit("0")))
    return out.select(
        F.col("_id").alias(id_col), "n_bytes", F.col("_leaf._d").cast("int").alias("depth"), bits.alias("shard"),
        F.col("_leaf._bytes").alias("shard_bytes"), F.col("_leaf._n").alias("shard_docs"), (F.col("_leaf._bytes") <= shard_bytes).alias("fits"),
    )


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the rows of df under path, a folder for each shard (shard=p<bits>); returns the directory (shard, bytes, rows)."""
    placed = extendible_shards(df, id_col, text_col, shard_bytes)
    keys = checkpoint(placed.select(F.col(id_col).alias("_of"), F.concat(F.lit("p"), "shard").alias("shard"), "shard_bytes", "shard_docs").distinct())
    rows = df.join(keys.select("_of", "shard"), df[id_col].eqNullSafe(keys["_of"])).drop("_of")
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return keys.select("shard", "shard_bytes", "shard_docs").distinct()


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(read(spark, sf_dir, "documents"))


SQL = f"""
with d as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
n as (select depth, h >> ({BITS} - depth) as prefix, sum(n_bytes)::bigint as bytes, count(*) as docs, min(h) = max(h) as one from d, (select unnest(generate_series(0, 24)) as depth) group by 1, 2),
leaf as (select doc_id, n_bytes, h, min(n.depth) as depth from d, n where n.prefix = d.h >> ({BITS} - n.depth) and (n.bytes <= {SHARD_BYTES} or n.one) group by doc_id, n_bytes, h)
select doc_id, n_bytes, leaf.depth::int as depth, case when leaf.depth = 0 then '' else right(lpad(bin(prefix), 64, '0'), leaf.depth::int) end as shard, bytes as shard_bytes, docs as shard_docs, bytes <= {SHARD_BYTES} as fits
from leaf join n on n.depth = leaf.depth and n.prefix = leaf.h >> ({BITS} - leaf.depth)
"""
