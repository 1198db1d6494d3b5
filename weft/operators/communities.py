"""Communities by modularity on graphs of any size: parallel local moves, then contraction, level by level.

A round looks, for every node, at the weight of its edges to each neighbouring community, and moves nodes to the
community that adds most modularity. All nodes decide on the same labels, so a rule keeps them from trading
places: they move to smaller labels only in even rounds, to larger ones only in odd rounds. The modularity of the
labels comes along with each round's table; the best labels of a level stay. Communities then become nodes, with
the edges between them summed up. In the end nodes move once more on the graph itself, from the labels found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import adjacency, nodes

Save = Callable[[DataFrame], DataFrame]


def _round(links: DataFrame, at: DataFrame, twice: float, turn: int) -> DataFrame:
    """(id, k, community, inner, loop, next): where each node goes, and the weight of its edges into its own community.

    links(a, b, w): both directions, no loops; at(id, k, loop, community): weighted degrees and labels.
    """
    near = links.join(at.select(F.col("id").alias("b"), F.col("community").alias("c")), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
    total = at.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("tot"))
    own = at.join(total.withColumnRenamed("c", "community"), "community").withColumnRenamed("tot", "own_tot")
    seen = near.join(total, "c").join(own.withColumnRenamed("id", "a"), "a")
    same = F.col("c") == F.col("community")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(same, F.col("k")).otherwise(0.0)) / twice
    ahead = F.col("c") < F.col("community") if turn % 2 == 0 else F.col("c") > F.col("community")
    best = seen.groupBy("a").agg(
        F.first("k").alias("k"),
        F.first("loop").alias("loop"),
        F.first("community").alias("community"),
        F.sum(F.when(same, F.col("w")).otherwise(0.0)).alias("inner"),
        F.max(F.when(same, gain)).alias("stay"),
        F.first(-F.col("k") * (F.col("own_tot") - F.col("k")) / twice).alias("alone"),
        F.max(F.when(ahead, F.struct(gain.alias("g"), (-F.col("c")).alias("c")))).alias("go"),
    )
    moves = F.col("go.g") > F.coalesce("stay", "alone") + 1e-9
    return best.select(F.col("a").alias("id"), "k", "loop", "community", "inner", F.when(moves, -F.col("go.c")).otherwise(F.col("community")).alias("next"))


def _level(links: DataFrame, loops: DataFrame, save: Save, rounds: int, patience: int, least: float, start: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(id, community) of the best labels found from start(id, community), by default every node on its own, and their modularity."""
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("w"))
    at = degree.join(loops, "id", "left").select("id", (F.col("w") + F.coalesce("loop", F.lit(0.0))).alias("k"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    at = save(at.withColumn("community", F.col("id")) if start is None else at.join(start, "id"))
    twice = at.agg(F.sum("k")).first()[0]
    best, best_q, waited = at.select("id", "community"), -1.0, 0
    for turn in range(rounds):
        moved = save(_round(links, at, twice, turn))
        each = moved.groupBy("community").agg(F.sum("k").alias("t"), F.sum(F.col("inner") + F.col("loop")).alias("w"), F.count_if(F.col("next") != F.col("community")).alias("n"))
        q, changes = each.agg(F.sum(F.col("w") / twice - (F.col("t") / twice) * (F.col("t") / twice)), F.sum("n")).first()
        waited = 0 if q > best_q + least else waited + 1
        if q > best_q:
            best, best_q = moved.select("id", "community"), q
        if waited >= patience or not changes and waited:
            break
        at = moved.select("id", "k", "loop", F.col("next").alias("community"))
    return best, best_q


def louvain(edges: DataFrame, save: Save, rounds: int = 40, patience: int = 2, least: float = 1e-4, levels: int = 20) -> DataFrame:
    """(id, community) of every node with an edge, labelled by the community's least id.

    A level ends after `patience` rounds that add less than `least` to the modularity, and all ends when a level
    adds less. Rounds don't depend on how rows are partitioned; each is two joins and three aggregations over
    the level's edges, which pre-aggregate, so a hub's edges aren't gathered.
    """
    of = save(nodes(edges).withColumn("community", F.col("id")))
    first = links = save(adjacency(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w")))
    none = of.select("id", F.lit(0.0).alias("loop")).limit(0)
    loops, before = none, -1.0
    for _ in range(levels):
        if links.isEmpty():
            break
        labels, q = _level(links, loops, save, rounds, patience, least)
        if q <= before + least:
            break
        before = q
        named = labels.select(F.col("id").alias("community"), F.col("community").alias("next"))
        # Nodes without a link to others keep their label.
        of = save(of.join(named, "community", "left").select("id", F.coalesce("next", "community").alias("community")))
        ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
        summed = save(ends.groupBy("ca", "cb").agg(F.sum("w").alias("w")))
        kept = loops.join(named.withColumnRenamed("community", "id"), "id", "left").select(F.coalesce("next", "id").alias("id"), "loop")
        inside = summed.where("ca = cb").select(F.col("ca").alias("id"), F.col("w").alias("loop"))
        loops = save(kept.unionByName(inside).groupBy("id").agg(F.sum("loop").alias("loop")))
        links = summed.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w")
    if before > -1.0:
        of, _ = _level(first, none, save, rounds, patience, least, of)
    least_id = of.groupBy("community").agg(F.min("id").alias("least"))
    return save(of.join(least_id, "community").select("id", F.col("least").alias("community")))
