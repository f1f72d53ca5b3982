"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.scratch import written

MAX_ROUNDS = 60  # the number of rounds grows with the square of the logarithm of the component size


def components(links: DataFrame) -> DataFrame:
    """``node, component``: each node of links ``a, b`` with the least node that it reaches.

    Large-star and small-star steps take turns until nothing changes. Both hang neighbours onto a least node by an aggregate and a join, so
    no task collects the neighbours of one node. Links of a node with itself and repeated links do no harm. Nulls take no part.
    """
    pairs = links.where("a is not null and b is not null").selectExpr("least(a, b) as low", "greatest(a, b) as high")
    edges = written(pairs.where("low < high").distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        edges = written(_small_star(_large_star(edges)), "links")
        old, state = state, _state(edges)
        if state == old:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return nodes.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node goes to the least one of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").selectExpr("m as low", "v as high").where("low < high").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(least, "high").selectExpr("m as low", "low as high").where("low < high")
    return moved.unionByName(least.selectExpr("m as low", "high")).distinct()
