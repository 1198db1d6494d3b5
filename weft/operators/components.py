"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round links every vertex to the least vertex it knows of; the rounds needed grow with the logarithm of
the number of vertices (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). Every step is a
grouped minimum and a join with it, and rounds end when no edge changes. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame], u: str = "u", v: str = "v") -> DataFrame:
    """Return (id, component) for every vertex of edges: component is the least id it is connected to.

    edges: (u, v) of one comparable type; direction, repetition and loops don't matter, rows with a null are
    dropped. save: materialises a DataFrame and cuts its lineage.
    """
    pairs = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    loops = pairs.where("a = b").select(F.col("a").alias("id"))
    star = save(pairs.where("a < b").distinct())
    vertices = star.select(F.col("a").alias("id")).union(star.select(F.col("b"))).union(loops).distinct()
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: each vertex links its larger neighbours to its least neighbour (or itself).
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = save(large)
        # Small star: each vertex links its smaller neighbours, and itself, to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m"), F.col("b")))
        star = save(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        # It has converged when every vertex has one edge and no root hangs on another.
        state = star.agg(F.count("*"), F.countDistinct("b"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not converge")
    return vertices.join(star.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
