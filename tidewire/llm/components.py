"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.llm.text import join_groups
from tidewire.session import materialise


# Up to so many edges, of two numbers each, even one node with all of them is little for a task.
FEW_EDGES = 1_000_000


def _with_low(edges: DataFrame, low: DataFrame, number: int) -> DataFrame:
    """Edges with the smallest neighbour ``m`` of their ``u``; those at a hub are not gathered by it."""
    if number <= FEW_EDGES:
        return edges.join(low.drop("n"), "u")
    return join_groups(edges, low, ["u"], "n", number)


def _large_star(edges: DataFrame, number: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_low(both, low, 2 * number).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, number: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    near = _with_low(edges, low, number).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges`` has two long columns u and v, in any order, repeats and loops allowed. Each round
    shortens every path to the root by a factor, so long chains end after a logarithmic number of
    rounds; each round's edges are written to the shared folder. Edges at a hub, such as the root of
    a giant component, are not gathered by it. Only a count and a checksum come
    to the driver. No edges: an empty result.
    """
    current = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        # No more edges come out of a step than go into it.
        current = materialise(_small_star(_large_star(current, mark[0]), mark[0]), "edges")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
