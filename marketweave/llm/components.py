"""Connected components by alternating large-star and small-star over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import drop, left_join, save

#: Edges for one task. Fewer stay in one, as adaptive execution would join them: a round is then one job without a shuffle.
TASK_EDGES = 1 << 17


def _with_min(edges: DataFrame, alone: bool) -> DataFrame:
    if alone:
        return edges.coalesce(1).withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    return left_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """links: a, b (any order, repeats and loops allowed, nulls ignored) -> id, component_id of every id that has a link.

    component_id is the smallest id reachable. No task gathers a neighbourhood of more than TASK_EDGES: minima come from partial aggregates, and
    a node with a huge number of neighbours is split by the join.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = save((edges.coalesce(1) if edges.count() <= TASK_EDGES else edges).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        alone = state[0] <= TASK_EDGES
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, alone).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if alone else save(large)
        near = _with_min(large, alone)
        moved = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        after = save((moved.coalesce(1) if alone else moved).distinct())
        drop(edges, *([] if alone else [large]))
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
