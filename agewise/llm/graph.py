"""Connected components of an edge table, as Spark jobs.

Each round replaces the edges by stars around smaller nodes (large-star, then small-star); the number
of rounds grows with the logarithm of the longest path.  Edges stay a distributed table throughout;
the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node is linked with the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the least of them (edges have a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return (edges.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("n"))
            .where("m <> n").select(F.col("m").alias("a"), F.col("n").alias("b")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """``(node, component)`` of every node of an edge table of longs; component: its least node.

    Self-loops and repeated or null edges are fine; a node with only a self-loop is not listed."""
    e = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == now or now[0] == 0:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        seen, e = now, materialize(_small_star(_large_star(e)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
