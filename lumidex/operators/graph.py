"""Connected components of an undirected graph in Spark.

Rounds of hooking and contraction: each node hooks to its smallest neighbour if that
is smaller, chains of hooks are shortened by pointer doubling, and the edges between
what then are different nodes make the next, smaller graph. A node is hooked in one round
only; its component is found at the end, from the last round back, so nodes are not
labelled anew in each round. Only aggregations with map-side combine and equi-joins, so a
node with very many edges is no hot spot. Each round is written to the folder that the
caller names, which cuts lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Save = Callable[[DataFrame, str], DataFrame]


def _lifted(parents: DataFrame, above: DataFrame) -> DataFrame:
    """(node, parent, moved) where a parent that is a node of above gives way to its parent there."""
    up = above.select(F.col("node").alias("up_node"), F.col("parent").alias("grand"))
    joined = parents.join(up, parents["parent"] == up["up_node"], "left")
    return joined.select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))


def _compressed(parents: DataFrame, save: Save) -> DataFrame:
    """(node, parent) with each parent a root; parents has no cycle and holds no root as a node.

    Only nodes that are parents too are doubled: their own parents are such nodes or roots.
    """
    heads = parents.select(F.col("parent").alias("head")).distinct()
    links = save(parents.join(heads, parents["node"] == heads["head"], "left_semi"), "links")
    if links.isEmpty():
        return parents
    while True:
        jumped = save(_lifted(links, links), "jump")
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return save(_lifted(parents, links).drop("moved"), "roots")


def connected_components(edges: DataFrame, save: Save) -> DataFrame:
    """(node, component) for each end of edges (a, b); component is the smallest node reachable. Null ends are left out."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = save(edges.where("a is not null and b is not null and a <> b").select(*ends).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        roots = _compressed(save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks"), save)
        rounds.append(roots)
        to = roots.select(F.col("node").alias("r_node"), F.col("parent").alias("root"))
        for end in ("b", "a"):  # most edges are inside one node once their larger end is a root
            joined = edges.join(to, edges[end] == to["r_node"], "left")
            edges = joined.select(*[F.coalesce("root", end).alias(end) if c == end else F.col(c) for c in ("a", "b")]).where("a <> b")
        edges = save(edges.select(*ends).distinct(), "edges")
    found = rounds.pop() if rounds else edges.select(F.col("b").alias("node"), F.col("a").alias("parent"))
    for roots in reversed(rounds):
        found = save(_lifted(roots, found).drop("moved"), "found").unionByName(found)
    least = found.select("parent").distinct()
    return found.select("node", F.col("parent").alias("component")).unionByName(least.select(F.col("parent").alias("node"), F.col("parent").alias("component")))
