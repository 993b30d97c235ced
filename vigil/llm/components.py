"""Connected components of a link table, all in Spark.

Large-star and small-star rounds (every node hands its neighbours to the
smallest it knows) on a written table a round, until nothing changes; the
number of rounds is logarithmic in the longest chain. Only two numbers a round
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import materialize

MAX_ROUNDS = 64


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of long ids. Returns (node, comp), comp being
    the smallest id reachable, for all nodes with a link to another."""
    u, v = links.columns
    edges = materialize(links.where(F.col(u) != F.col(v)).select(
        F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _mark(edges)
        if now == mark:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                roots.select("node", F.col("node").alias("comp")))
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
