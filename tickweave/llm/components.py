"""Connected components of links as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: a node's larger (large) or smaller (small) neighbours are tied to the smallest node it sees.

    The smallest neighbour comes from an aggregate that combines before the shuffle, and goes back by a join, which Spark
    splits where one node has most of the links.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = both.join(low, "a")
    out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, component) for every node that has a link; component is the smallest id reachable.

    Alternates large and small stars until nothing changes; a link's ends may come in any order, repeated or equal. Each
    round is cut, so that a lost executor repeats one round at most.
    """
    edges = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sign(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        edges = cut(_stars(_stars(edges, True), False))
        now = sign(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
