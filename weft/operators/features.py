"""Pair features from the topology of a graph, for whole tables of pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import adjacency, degree

LOCAL = (
    "common_neighbors", "jaccard_coefficient", "adamic_adar", "resource_allocation", "preferential_attachment",
    "sorensen_index", "salton_cosine", "hub_promoted_index", "hub_depressed_index", "degree_sum", "degree_diff", "degree_ratio",
)
ALL = (*LOCAL[:9], "pagerank_product", "pagerank_diff", "closeness_product", *LOCAL[9:], "same_community")


def two_hop_pairs(edges: DataFrame) -> DataFrame:
    """Pairs u < v with a common neighbour that aren't edges."""
    adj = adjacency(edges)
    other = adj.withColumnRenamed("dst", "v")
    found = adj.join(other, "src").where("dst < v").select(F.col("dst").alias("u"), "v").distinct()
    return found.join(edges, ["u", "v"], "left_anti")


#: Neighbours of a node that are paired in one task; a hub's are split into parts of about so many.
PART = 1024


def two_hop_features(edges: DataFrame) -> DataFrame:
    """The local features of all pairs u < v with a common neighbour that aren't edges, from one pass over wedges.

    A wedge carries its middle's degree, so counts and sums come from the same grouping as the pairs. A hub's
    neighbours are dealt to parts by hash: each neighbour meets each part, in a task of its own.
    """
    measured = measures(F.col("_du"), F.col("_dv"), F.col("_cn"), F.coalesce("_aa", F.lit(0.0)), F.col("_ra"))
    # The ends' degrees come along, so pairs move once; where no measure asks for them they are pruned.
    met = shared(edges, F.first("_du").alias("_du"), F.first("_dv").alias("_dv"))
    return met.join(edges, ["u", "v"], "left_anti").select("u", "v", *[c.alias(n) for n, c in measured.items()])


def shared(edges: DataFrame, *more: Column) -> DataFrame:
    """(u, v, _cn, _aa, _ra, more) of all pairs u < v with a common neighbour, edges among them.

    more: aggregates over the wedges of a pair, which have the middle as src and the ends' degrees as _du, _dv.
    """
    deg = degree(edges)
    arms = adjacency(edges).join(deg.toDF("src", "d"), "src").join(deg.toDF("dst", "_d"), "dst")
    parts = F.ceil(F.col("d") / PART).cast("int")
    left = arms.select("src", "d", F.col("dst").alias("u"), F.col("_d").alias("_du"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = arms.select("src", F.col("dst").alias("v"), F.col("_d").alias("_dv"), F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part"))
    return _shared(left.join(right, ["src", "part"]).where("u < v"), *more)


def _shared(wedges: DataFrame, *more: Column) -> DataFrame:
    """(u, v, _cn, _aa, _ra, more) of wedges (u, v, d), d the middle's degree."""
    log_share = F.when(F.col("d") > 1, 1.0 / F.log(F.when(F.col("d") > 1, F.col("d")).cast("double")))
    return wedges.groupBy("u", "v").agg(F.count("*").alias("_cn"), F.sum(log_share).alias("_aa"), F.sum(F.lit(1.0) / F.col("d")).alias("_ra"), *more)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def measures(d_u: Column, d_v: Column, cn: Column, aa: Column, ra: Column) -> dict[str, Column]:
    low, high = F.least(d_u, d_v), F.greatest(d_u, d_v)
    return {
        "common_neighbors": cn,
        "jaccard_coefficient": ratio(cn, d_u + d_v - cn),
        "adamic_adar": aa,
        "resource_allocation": ra,
        "preferential_attachment": d_u * d_v,
        "sorensen_index": ratio(2 * cn, d_u + d_v),
        "salton_cosine": ratio(cn, F.sqrt((d_u * d_v).cast("double"))),
        "hub_promoted_index": ratio(cn, low),
        "hub_depressed_index": ratio(cn, high),
        "degree_sum": d_u + d_v,
        "degree_diff": F.abs(d_u - d_v),
        "degree_ratio": ratio(low, high),
    }


def local_features(edges: DataFrame, pairs: DataFrame, exclude_self_edge: bool = False) -> DataFrame:
    """pairs(u, v, ...) with the local features; nodes that aren't in the graph count as of degree 0.

    exclude_self_edge: a pair that is an edge gets the features it would have without that edge, as test pairs do;
    only the degrees of its ends change by it.

    Only the requested pairs' wedges are expanded: pairs join the adjacency of u, and that of v on the same
    middle node, which brings its degree along. If u and v are linked, each counts among the other's neighbours.
    """
    adj, deg = adjacency(edges), degree(edges)
    keys = pairs.select("u", "v").distinct()
    weighed = adj.join(deg.select(F.col("id").alias("dst"), "d"), "dst").select(F.col("src").alias("u"), F.col("dst").alias("z"), "d")
    wedges = keys.join(weighed, "u").join(adj.select(F.col("src").alias("v"), F.col("dst").alias("z")), ["v", "z"])
    full = pairs.join(_shared(wedges), ["u", "v"], "left").join(deg.toDF("u", "_du"), "u", "left").join(deg.toDF("v", "_dv"), "v", "left")
    zero = F.lit(0).cast("bigint")
    own = zero
    if exclude_self_edge:
        linked = edges.select(F.col("u").alias("_a"), F.col("v").alias("_b"), F.lit(1).cast("bigint").alias("_own"))
        full = full.join(linked, (F.least("u", "v") == F.col("_a")) & (F.greatest("u", "v") == F.col("_b")), "left")
        own = F.coalesce("_own", zero)
    measured = measures(F.coalesce("_du", zero) - own, F.coalesce("_dv", zero) - own, F.coalesce("_cn", zero), F.coalesce("_aa", F.lit(0.0)), F.coalesce("_ra", F.lit(0.0)))
    return full.select(*pairs.columns, *[c.alias(n) for n, c in measured.items()])


def set_features(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by neighbour arrays: for few pairs of nodes of bounded degree, and to check the joins against."""
    adj, deg = adjacency(edges), degree(edges)
    lists = adj.join(deg.toDF("dst", "d"), "dst").groupBy("src").agg(F.collect_set(F.struct(F.col("dst").alias("z"), "d")).alias("n"))
    full = pairs.join(lists.toDF("u", "_nu"), "u", "left").join(lists.toDF("v", "_nv"), "v", "left")
    empty = F.array().cast("array<struct<z:bigint,d:bigint>>")
    nu, nv = F.coalesce("_nu", empty), F.coalesce("_nv", empty)
    both = F.array_intersect(nu, nv)
    total = lambda each: F.aggregate(both, F.lit(0.0), lambda s, x: s + each(x["d"].cast("double")))
    measured = measures(F.size(nu).cast("bigint"), F.size(nv).cast("bigint"), F.size(both).cast("bigint"), total(lambda d: F.when(d > 1, 1.0 / F.log(F.when(d > 1, d))).otherwise(0.0)), total(lambda d: 1.0 / d))
    return full.select(*pairs.columns, *[c.alias(n) for n, c in measured.items()])


def node_features(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """pairs with features of both ends' scalars; stats(id, pagerank, closeness, community).

    Missing nodes have rank and closeness 0 and no community in common with any.
    """
    a, b = _ends(stats)
    return pairs.join(a, "u", "left").join(b, "v", "left").select(*pairs.columns, *node_measures())


#: Nodes of a part of all_node_features: rows of a task name no more ends than that, so they take little room when written.
NODE_PART = 4096


def all_node_features(stats: DataFrame) -> DataFrame:
    """(u, v) with the same features for all pairs u < v of nodes in stats: both ends' scalars meet in the join that
    makes the pairs, so pairs are never shuffled, and neither side is broadcast. n * n / 2 rows; stats is read twice."""
    a, b = _ends(stats)
    parts = max(1, -(-stats.count() // NODE_PART))
    few = 4 * stats.sparkSession.sparkContext.defaultParallelism  # few rows, much work
    a = a.repartition(max(parts, few)).sortWithinPartitions("u")
    b = b.repartition(parts).sortWithinPartitions("v")
    return a.hint("shuffle_replicate_nl").join(b, F.col("u") < F.col("v")).select("u", "v", *node_measures())


def _ends(stats: DataFrame) -> list[DataFrame]:
    return [stats.select(F.col("id").alias(e), *[F.col(c).alias(f"_{e}_{c}") for c in ("pagerank", "closeness", "community")]) for e in ("u", "v")]


def node_measures() -> list[Column]:
    value = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        (value("_u_pagerank") * value("_v_pagerank")).alias("pagerank_product"),
        F.abs(value("_u_pagerank") - value("_v_pagerank")).alias("pagerank_diff"),
        (value("_u_closeness") * value("_v_closeness")).alias("closeness_product"),
        F.when(F.col("_u_community") == F.col("_v_community"), 1).otherwise(0).alias("same_community"),
    ]


def pair_features(edges: DataFrame, pairs: DataFrame, stats: DataFrame, exclude_self_edge: bool = False) -> DataFrame:
    """All sixteen features of pairs(u, v, ...)."""
    return node_features(local_features(edges, pairs, exclude_self_edge), stats).select(*pairs.columns, *ALL)
