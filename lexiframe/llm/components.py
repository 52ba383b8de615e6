"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _digest(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one comparable type); the root is the smallest
    node that can be reached. Each round is written to the shared folder. Neighbour minima are aggregated before
    the shuffle, and joined as a written table, so that the planner may split the rows of a node with many
    neighbours. Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is tied to the smallest of the node and its neighbours
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u"), "low")
        large = stored(both.where("b > a").join(low, F.col("a") == F.col("u")).where("b <> m")
                       .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small star: a node and its neighbours below it are tied to the smallest of them
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "low")
        below = large.join(low, F.col("a") == F.col("u"))
        now = stored(below.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        state = _digest(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
