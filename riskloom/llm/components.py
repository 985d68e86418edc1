"""Connected components of a graph held in DataFrames: alternating large and small stars.

Every round is two aggregations and joins on a node, cut by a written table; nothing but two sums per round reaches the driver.  The rows of a
node with very many neighbours stay where they are (``looked_up``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import looked_up
from riskloom.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """u, v and m, the least neighbour of u, for each of ``total`` pairs."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return looked_up(pairs, least, "u", total)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the smallest node reachable."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, size = None, edges.count()
    for _ in range(most_rounds):
        # larger neighbours of a node to the smallest of the node and its neighbours
        large = _star(_both(edges), 2 * size).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # each node's smaller neighbours, and the node itself, to the smallest of them
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
        starred = _star(down, size)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
