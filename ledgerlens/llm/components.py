"""Connected components of an edge list, by large-star and small-star rounds over DataFrames.

Each round is two aggregations with a minimum for each node, which Spark combines before it
shuffles, and joins on the node that adaptive execution can split; edges are cut from their lineage
by a written table each round.  Nothing is collected but the number of edges that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of each node a (the larger ones, or the smaller ones and a) at its smallest."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(least, "a")
    if large:
        return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), of any type that has an order: root is the smallest node it reaches."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (sign.n, sign.h) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = (sign.n, sign.h)
        before, now = now, written(_star(_star(now, large=True), large=False), "edges")
        dropped(before)
    raise RuntimeError("components did not settle")
