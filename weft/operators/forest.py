"""Spanning forests in a number of rounds that grows with the logarithm of the nodes (Borůvka's contraction)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators.graph import nodes

Save = Callable[[DataFrame], DataFrame]


def _roots(hooks: DataFrame, save: Save) -> DataFrame:
    """(id, root) where hooks(id, to) point at other components, two of them at each other in every tree.

    The smaller of the two is the root. Pointers are doubled until all rest on a root.
    """
    back = hooks.select(F.col("id").alias("to"), F.col("to").alias("back"))
    own = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
    at = save(hooks.join(back, "to", "left").select("id", F.when(own, F.col("id")).otherwise(F.col("to")).alias("root")))
    while True:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = save(at.join(ahead, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("id", "root")
        at = at.select("id", "root")


def minimum_forest(edges: DataFrame, save: Save, seed: int = 42, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """Forest edges (u, v) of edges(u, v): the minimum spanning forest by the MD5 of seed and edge, which is unique.

    Every round each component takes its least edge to another one, components that hang together become one, and
    edges inside of components are dropped: at least half of the components go. on_round is told each round's
    number. Hashed weights keep chains of hooks short, and a component's least edge is a grouped minimum that
    pre-aggregates, so a hub's edges aren't gathered.
    """
    key = hashing.key(seed, "forest", "u", "v")
    left = save(edges.select("u", "v", key.alias("key"), F.col("u").alias("a"), F.col("v").alias("b")))
    forest = None
    for turn in range(1, 65):
        if left.isEmpty():
            break
        if on_round is not None:
            on_round(turn)
        edge = F.struct("key", "u", "v", "a", "b")
        least = left.select(F.explode(F.array("a", "b")).alias("id"), edge.alias("e")).groupBy("id").agg(F.min("e").alias("e"))
        least = save(least.select("id", "e.u", "e.v", F.when(F.col("id") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")).alias("to")))
        taken = least.select("u", "v").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        roots = _roots(least.select("id", "to"), save)
        ends = left.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").where("ra <> rb")
        left = save(ends.select("u", "v", "key", F.col("ra").alias("a"), F.col("rb").alias("b")))
    return forest if forest is not None else edges.select("u", "v").limit(0)


def components_of(edges: DataFrame, forest: DataFrame) -> int:
    """How many components the forest's nodes have: nodes less edges."""
    return nodes(edges).count() - forest.count()
