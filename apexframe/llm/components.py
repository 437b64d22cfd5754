"""Connected components by alternating large-star and small-star steps, all in Spark windows and aggregations: three shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every u hands the smallest of itself and its neighbours to its larger neighbours. Edges are (a, b) with a > b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.v").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return both.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every u ties itself and its smaller neighbours to the smallest of these. Edges may repeat; the result's don't."""
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    tied = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return least.select(tied.alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Pairs (a, b) of 64-bit ids in any order to (node, component): each node's smallest reachable id.

    Only nodes that have an edge to another node appear. Self-pairs and repeated pairs don't matter.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    for _ in range(max_rounds):
        edges = materialize(_small_star(_large_star(edges)), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
