"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.common import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b), root being the component's smallest node.

    Links may repeat, run either way or join a node to itself (such nodes get
    themselves). Each round is written to the checkpoint folder; the rounds grow
    with the logarithm of the longest chain, and no node's links meet in one task.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    stars = cut(links.where("a <> b"))
    before = None
    while before != (now := _state(stars)):
        before = now
        stars = cut(_small_star(_large_star(stars)))
    joined = nodes.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return joined.select("node", F.coalesce("root", "node").alias("root"))
