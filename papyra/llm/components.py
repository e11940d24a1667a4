"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import checkpoint, scratch


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s or 0


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v): v is a neighbour of u. The neighbours of u (and u itself) get linked to their minimum.

    Both sides of the join are written tables with a shuffle each, so adaptive execution splits the rows of a node of
    high degree over tasks.
    """
    low = checkpoint(pairs.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("_low")))
    near = pairs.join(low, "u")
    if not small:
        near = near.where("v > u")
    out = near.select(F.col("v").alias("u"), F.col("_low").alias("v")).unionByName(low.select("u", F.col("_low").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, label): the smallest node reachable, for every node of links (u, v) that isn't its own label.

    Links are symmetric; self links and repeats are ignored; none give an empty table. Rounds grow with the logarithm
    of a component's size. Nothing is collected but a count and a checksum, which tell when nothing changes.
    """
    links = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = _state(links)
    while state[0]:
        with scratch(links.sparkSession) as keep:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = checkpoint(_stars(both, small=False))
            links = checkpoint(_stars(large, small=True))
            keep(links)
        was, state = state, _state(links)
        if was == state:
            break
    return links.select("u", F.col("v").alias("label"))
