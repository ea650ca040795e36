"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is two aggregations and two joins over the edges; every node of a component ends up with one
edge to its smallest node. A centre with very many neighbours is an aggregation key with a
partial minimum and a join key that adaptive execution may split, never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewagon.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of every node, and the node itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def smallest_reachable(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): each node with an edge and the smallest node of its component, except for that node itself.

    ``edges`` has two columns u and v of one ordered type. The number of rounds is logarithmic in the size of a
    component; each round is written, so a lost executor costs at most one round.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .distinct(), label)
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            return now
        state = mark
        now = written(_small_star(_large_star(now)), label)
