"""Connected components of an edge table, by large-star and small-star rounds.

Each round points every node to the smallest of its neighbours; a few rounds (logarithmic in the longest path) leave
a star per component. Every round is a shuffle of the edges and is written to the shared folder, so that no
lineage grows; the number of rounds isn't bounded. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """``edges``: longs ``a`` and ``b``. Returns ``node`` and the smallest node ``root`` of its component, for all nodes but the roots."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        now = written(_small_star(_large_star(now)), "star")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
