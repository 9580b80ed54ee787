"""Connected components of a graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ordered import stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node it is connected to.

    `nodes` has a column `node`, `edges` columns `a` and `b`, in one direction or both. In every round each node, and the node it
    points at, take the smallest label seen across an edge, and then skip to where that label points. Rounds grow with the
    logarithm of the longest path, and each is written, so lineage does not grow.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = both.join(of_a, "a").join(of_b, "b").where("rb < ra")
        hooked = across.select(F.explode(F.array("a", "ra")).alias("node"), "rb").groupBy("node").agg(F.min("rb").alias("rb"))
        moved = labels.join(hooked, "node", "left").select("node", "root", F.least("root", F.coalesce("rb", "root")).alias("next"))
        moved = stored(moved)
        ahead = moved.select(F.col("node").alias("next"), F.col("next").alias("further"))
        skipped = moved.join(ahead, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("root"), (F.col("root") != F.least("next", F.coalesce("further", "next"))).alias("changed"))
        now = stored(skipped)
        labels = now.select("node", "root")
        if now.where("changed").isEmpty():
            return labels
