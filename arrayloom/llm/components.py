"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut_counted


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its greater neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    over = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Each node has one edge, to a root that has none of its own."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("goes")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("goes")))
    return ends.groupBy("x").agg(F.sum("goes").alias("n"), F.min("goes").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges(u, v)`` but the roots themselves, the smallest node it can reach.

    Nulls and loops are left out; repeated edges count once; no edges give no rows. Steps grow with the
    logarithm of the longest path; each is written to the checkpoint folder and read in as many partitions
    as its rows ask for. A node with very many neighbours is split by the adaptive skew join; its minimum is
    aggregated before the shuffle.
    """
    now, n = cut_counted(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v and u is not null and v is not null").distinct())
    while n and not _settled(now):
        now, n = cut_counted(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
