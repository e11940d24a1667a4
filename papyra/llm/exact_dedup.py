"""Exact dedup by two-pass Bloom filtering; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import LOWER, UPPER, ascii_lower, checkpoint, read, skew_safe_join

BITS_PER_ROW = 32
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28


def slices(n: int, bits_per_row: float = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """How many ranges of hashes n rows are dealt to, so that each has bits_per_row bits a row within max_bits."""
    return max(1, math.ceil(n * bits_per_row / max_bits))


def slice_column(k: int) -> Column:
    """The number of the hash's range: k ranges of nearly equal width, by the upper 32 bits."""
    return F.shiftright((F.shiftright("_h", 32) + F.lit(1 << 31)) * F.lit(k), 32).cast("int")


def least(i: int, k: int) -> int:
    """The least hash of range i."""
    return (-(-(i << 32) // k) << 32) - (1 << 63)


def repeat_filter(hashes: DataFrame, n: int, k: int, bits_per_row: float = BITS_PER_ROW, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Pass 1: blocked Bloom filters of what may occur twice, one for each of k ranges of hashes, as rows (_slice, _word,
    _mask) of 64-bit words, and the words of each filter.

    A hash (column _h) sets one bit of its range's filter. Bits set by at least two rows are kept. Counting is a partial
    aggregate, so a value held by a third of all rows is one count per task. A filter has at most max_bits bits, the
    bound under which it is broadcast; n rows have more filters, not fuller ones.
    """
    bits = min(max_bits, max(MIN_BITS, 1 << max(1, int(n / k * bits_per_row - 1)).bit_length()))
    words = bits // 64
    cells = hashes.select(slice_column(k).alias("_slice"), word_column(words).alias("_word"), bit_column().alias("_bit"))
    twice = cells.groupBy("_slice", "_word", "_bit").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return twice.groupBy("_slice", "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask")).sortWithinPartitions("_slice"), words


def word_column(words: int) -> Column:
    return F.pmod(F.col("_h"), F.lit(words))


def bit_column() -> Column:
    """From bits that tell neither ranges nor words (of which there are at most 2**26) apart."""
    return F.expr("cast(shiftrightunsigned(_h, 26) & 63 as int)")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: float = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so null and empty texts form
    one group. The row with the largest id stays; null ids sort below all others (a group of null ids only has a null
    keep_id and keeps its rows). Rows that repeat an id each get a row; all rows that carry the kept id and text are
    kept. An empty table gives an empty result. Columns other than the two named are ignored, whatever their names.

    Pass 1 hashes every row once (the only read of the texts) and builds the repeat filters. Pass 2 takes one range of
    hashes after another, which tasks wrote sorted, so that a scan skips the others; rows outside its filter go straight
    through, and only possible repeats shuffle, as (digest, id).
    """
    rows = checkpoint(
        df.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("_sha"))
        .withColumn("_h", F.xxhash64("_sha")).sortWithinPartitions("_h")
    )
    n = rows.count()
    k = slices(n, bits_per_row, max_bits)
    masks, words = repeat_filter(rows, n, k, bits_per_row, max_bits)
    masks = checkpoint(masks) if k > 1 else masks
    has = F.col("_mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit_column())) != 0

    def probed(i: int) -> DataFrame:
        own = rows if k == 1 else rows.where((F.col("_h") >= least(i, k)) & (F.col("_h") <= least(i + 1, k) - 1))
        found = own.withColumn("_word", word_column(words)).join(F.broadcast(masks.where(F.col("_slice") == i)), "_word", "left")
        return found.select("_id", "_sha", F.coalesce(has, F.lit(False)).alias("_maybe"))

    both = checkpoint(*(probed(i) for i in range(k)))
    single = both.where(~F.col("_maybe")).select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = both.where("_maybe").select("_id", "_sha")
    groups = checkpoint(maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    out = single.unionByName(skew_safe_join(maybe, groups, "_sha", "group_size", n))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256 from d join g using (text_sha256)
"""
