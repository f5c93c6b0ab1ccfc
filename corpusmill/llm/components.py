"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood. The
    smallest are written before the join, so that its sides are plain shuffles and
    Spark can split the centre of a star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(written(low), "a").select(F.col("low").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; a < b in ``edges``."""
    low = written(edges.groupBy("b").agg(F.min("a").alias("low")))
    moved = edges.join(low, "b").where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), "b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; a < b); root is the smallest
    node of the component. Each round is written in the shared folder; the rounds
    end when the edges no longer change, after about log(n) of them."""
    edges = written(edges.where("a < b").distinct())
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
