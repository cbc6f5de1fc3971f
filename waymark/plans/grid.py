"""Joins over grid cells, and stages that only see what earlier stages left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def grid_join(left: DataFrame, right: DataFrame, scale: float, ring: int) -> DataFrame:
    """Pairs whose cells (round(degrees x scale)) are at most ``ring`` apart in either direction.

    The right side, the smaller one, is repeated for its (2 x ring + 1)^2 neighbouring cells, and the join is on
    equal cells: Spark may hash or sort it, and there is no product of all rows.  Right columns get the prefix r_.
    """
    cell = lambda c: F.round(F.col(c) * F.lit(scale)).cast("long")
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    spread = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cell("lat").alias("_w_a"), cell("lon").alias("_w_b"))
    spread = spread.withColumn("_w_da", F.explode(steps)).withColumn("_w_db", F.explode(steps))
    spread = spread.withColumn("_w_a", F.col("_w_a") + F.col("_w_da")).withColumn("_w_b", F.col("_w_b") + F.col("_w_db")).drop("_w_da", "_w_db")
    own = left.withColumn("_w_la", cell("lat")).withColumn("_w_lb", cell("lon"))
    return own.join(spread, (F.col("_w_la") == F.col("_w_a")) & (F.col("_w_lb") == F.col("_w_b"))).drop("_w_a", "_w_b", "_w_la", "_w_lb")


def staged(queries: DataFrame, key: str, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Answers of the first stage that has any for a query; later stages only run on what is left."""
    from waymark.runtime import materialize

    found, left = None, queries
    for i, stage in enumerate(stages):
        got = stage(left)
        if i < len(stages) - 1:
            got = materialize(got, f"stage-{i}")
        found = got if found is None else found.unionByName(got)
        if i < len(stages) - 1:
            left = materialize(left.join(got.select(key).distinct(), key, "left_anti"), f"left-{i}")
            if left.isEmpty():
                break
    return found
