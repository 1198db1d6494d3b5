"""Graphs as DataFrames: canonical edges (u < v, distinct, no loops), and what is built from them.

An undirected simple graph is a table edges(u, v); nodes(id) is its end points unless isolated nodes count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import hashing, ranges


def dedup_undirected(raw: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Collapse direction and repetition, drop loops and edges with a null end."""
    ends = raw.select(F.col(u).cast("bigint").alias("a"), F.col(v).cast("bigint").alias("b")).where("a <> b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst), both directions: one pass over edges."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.src", "e.dst")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(id, d) of nodes with an edge."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))


def neighbors(edges: DataFrame) -> DataFrame:
    """(id, neighbors): sorted neighbour lists."""
    return adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(u, v, ...) with connected: whether they are an edge, in either direction."""
    known = edges.select(F.col("u").alias("_a"), F.col("v").alias("_b"), F.lit(True).alias("_e"))
    return pairs.join(known, (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b")), "left").withColumn("connected", F.coalesce("_e", F.lit(False))).drop("_a", "_b", "_e")


def induced_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(id)."""
    ids = keep.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")


def relabel_contiguous(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges over 0..n-1, mapping(id, idx)): the order of ids is kept.

    Ranks come from a range-partitioned sort and counts of its parts, so no task holds all ids.
    """
    mapping = dense_rank_of(vertices.select("id").distinct(), "id").withColumnRenamed("rank", "idx")
    a, b = mapping.toDF("u", "iu"), mapping.toDF("v", "iv")
    out = edges.join(a, "u").join(b, "v").select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v"))
    return out, mapping


def dense_rank_of(distinct: DataFrame, column: str) -> DataFrame:
    """(column, rank from 0) of distinct values: counts of ranges cut at quantiles, then ranks within each."""
    placed = distinct.withColumn("_block", ranges.blocks(distinct, column))
    sizes = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_block").orderBy(column)) - 1)
    return inside.join(sizes, "_block").select(column, (F.col("_before") + F.col("_rank")).cast("bigint").alias("rank"))


def largest_component(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges of the component with the most nodes; of equal ones that of the least id. labels(id, component)."""
    return edges.join(largest_members(labels).select(F.col("id").alias("u")), "u", "left_semi").select("u", "v")


def largest_members(labels: DataFrame) -> DataFrame:
    """(id) of that component."""
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(top, "component", "left_semi").select("id")


def max_degree_node(edges: DataFrame) -> DataFrame:
    return degree(edges).orderBy(F.desc("d"), "id").limit(1)


def head_nodes_subgraph(edges: DataFrame, limit: int) -> DataFrame:
    """Edges among the `limit` least node ids."""
    return induced_subgraph(edges, nodes(edges).orderBy("id").limit(limit))


def bfs_levels(edges: DataFrame, sources: DataFrame, save, most: int | None = None) -> DataFrame:  # noqa: ANN001
    """(src, id, dist): hop distances from each source; src at 0. One round a level, for all sources together."""
    adj = adjacency(edges).toDF("id", "next")
    frontier = save(sources.select(F.col("id").alias("src"), "id").distinct().withColumn("dist", F.lit(0).cast("bigint")))
    seen = frontier
    for level in range(1, 1 << 30):
        if most is not None and level > most:
            break
        reached = frontier.join(adj, "id").select("src", F.col("next").alias("id")).distinct()
        frontier = save(reached.join(seen.select("src", "id"), ["src", "id"], "left_anti").withColumn("dist", F.lit(level).cast("bigint")))
        if frontier.isEmpty():
            break
        seen = save(seen.unionByName(frontier)) if level % 8 == 0 else seen.unionByName(frontier)
    return seen


def k_hop_ego(edges: DataFrame, focus: int, cutoff: int, save, cap: int | None = None) -> DataFrame:  # noqa: ANN001
    """Edges among the nodes within cutoff hops of focus; cap keeps the nearest (then least ids), focus always."""
    start = edges.sparkSession.createDataFrame([(focus,)], "id bigint")
    near = bfs_levels(edges, start, save, cutoff).select("id", "dist")
    if cap is not None:
        near = near.orderBy("dist", "id").limit(max(cap, 1))
    return induced_subgraph(edges, near)


def bfs_sample(edges: DataFrame, target: int, seed: int, save) -> DataFrame:  # noqa: ANN001
    """Nodes (id, rank) of a breadth-first walk from the hub until `target` are reached.

    A node belongs to its earliest parent; siblings come in the order of their MD5.
    """
    adj = adjacency(edges)
    found = save(max_degree_node(edges).select("id", F.lit(0).cast("bigint").alias("rank")))
    frontier, n = found, 1
    while n < target:
        reached = frontier.join(adj, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("rank").alias("parent"))
        fresh = reached.join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        # The window holds the nodes that are still wanted, not the frontier.
        order = W.orderBy("parent", "key", "dst")
        fresh = fresh.withColumn("key", hashing.key(seed, "bfs", "dst")).orderBy("parent", "key", "dst").limit(target - n)
        frontier = save(fresh.select(F.col("dst").alias("id"), (F.row_number().over(order) - 1 + F.lit(n)).cast("bigint").alias("rank")))
        new = frontier.count()
        if not new:
            break
        found, n = save(found.unionByName(frontier)), n + new
    return found.where(F.col("rank") < target)


def spanning_forest(edges: DataFrame, labels: DataFrame, save) -> DataFrame:  # noqa: ANN001
    """Forest edges (u, v): breadth-first from the least id of each component, parent the least neighbour a level up."""
    roots = labels.select(F.col("component").alias("id")).distinct()
    dist = save(bfs_levels_from(edges, roots, save))
    up = adjacency(edges).join(dist.toDF("src", "ds"), "src").join(dist.toDF("dst", "dd"), "dst").where("dd = ds - 1")
    return up.groupBy("src").agg(F.min("dst").alias("parent")).select(F.least("src", "parent").alias("u"), F.greatest("src", "parent").alias("v"))


def bfs_levels_from(edges: DataFrame, roots: DataFrame, save) -> DataFrame:  # noqa: ANN001
    """(id, dist) to the nearest root."""
    adj = adjacency(edges)
    frontier = save(roots.select("id").distinct().withColumn("dist", F.lit(0).cast("bigint")))
    seen, level = frontier, 0
    while True:
        level += 1
        reached = frontier.join(adj, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = save(reached.join(seen.select("id"), "id", "left_anti").withColumn("dist", F.lit(level).cast("bigint")))
        if frontier.isEmpty():
            return seen
        seen = save(seen.unionByName(frontier))


def what_if_edges(edges: DataFrame, u: Column | int, v: Column | int, k: int) -> DataFrame:
    """edges and k new nodes (ids from the largest + 1001 on), each linked to u and v."""
    top = edges.agg(F.max(F.greatest("u", "v")).alias("m"))
    fake = top.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "m").select((F.col("m") + 1001 + F.col("i")).alias("w")) if k else None
    if fake is None:
        return edges.select("u", "v")
    new = fake.select(F.explode(F.array(F.lit(u).cast("bigint"), F.lit(v).cast("bigint"))).alias("u"), F.col("w").alias("v"))
    return edges.select("u", "v").unionByName(new.select("u", "v"))
