"""Connected components with alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (u, v, any ordered type) to (u, v): every linked node but the least of each component, and that least node.

    Each round reduces edges before nodes meet them, and the join that gives a node's least neighbour to its edges
    is one that Spark can split, so a node with very many links is no hot key.  The number of rounds grows with
    the logarithm of the size of a component.
    """
    u, v = F.col("u"), F.col("v")
    edges = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = materialize(edges, "links")
    seen = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("w"), F.least("u", "m").alias("m")), "large-least")
        large = both.where(v > u).join(least, u == F.col("w")).select(v.alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(u != v).distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("w"), "m"), "small-least")
        small = large.join(least, u == F.col("w")).select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), "small-star")
        now = _mark(edges)
        if now == seen:
            return edges
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
