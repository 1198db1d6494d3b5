"""Leak-free edge splits: a spanning forest stays in training, test and validation come from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import graph as G
from weft.operators.components import connected_components


def removable_edges(edges: DataFrame, forest: DataFrame) -> DataFrame:
    return edges.join(forest, ["u", "v"], "left_anti")


def split_counts(total: int, removable: int, test: float = 0.15, val: float = 0.05) -> tuple[int, int]:
    """Test and validation sizes, truncated; if they ask for more than is removable, fixed shares of it."""
    t, v = int(total * test), int(total * val)
    if t + v > removable:
        scale = removable / (t + v)
        t, v = int(t * scale * 0.75), int(v * scale * 0.25)
    return t, v


def ranked(rows: DataFrame, seed: int, purpose: str) -> DataFrame:
    """(u, v, rank from 1) in the order of the pairs' MD5.

    Ranks come from counts of the first 12 bits' ranges and ranks within them, not from one task.
    """
    keyed = rows.select("u", "v", hashing.key(seed, purpose, "u", "v").alias("k")).withColumn("b", F.substring("k", 1, 3))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = keyed.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("k", "u", "v")))
    return inside.join(sizes, "b").select("u", "v", (F.col("before") + F.col("r")).cast("bigint").alias("rank"))


def split_assign(edges: DataFrame, forest: DataFrame, save, test: float = 0.15, val: float = 0.05, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """edges with split: test, val or train."""
    loose = save(removable_edges(edges, forest))
    t, v = split_counts(edges.count(), loose.count(), test, val)
    order = ranked(loose, seed, "split")
    name = F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "val").otherwise("train")
    return order.select("u", "v", name.alias("split")).unionByName(edges.join(forest, ["u", "v"], "left_semi").select("u", "v", F.lit("train").alias("split")))


def train_graph(assigned: DataFrame) -> DataFrame:
    return assigned.where("split = 'train'").select("u", "v")


def non_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All pairs u < v that aren't edges: n * n rows, for graphs of a few thousand nodes."""
    ids = (G.nodes(edges) if nodes is None else nodes).select("id")
    pairs = ids.withColumnRenamed("id", "u").join(ids.withColumnRenamed("id", "v"), F.col("u") < F.col("v"))
    return pairs.join(edges, ["u", "v"], "left_anti")


def negative_sample(edges: DataFrame, k: int, save, seed: int = 42, complement_up_to: int = 3000) -> DataFrame:  # noqa: ANN001
    """(u, v, rank): k distinct non-edges by MD5, fewer where there aren't as many.

    Small graphs rank all non-edges. Larger ones draw pairs of node indices by MD5 and reject loops, edges and
    repetitions, in growing rounds until k are left: no n * n rows.
    """
    ids = save(G.nodes(edges))
    n = ids.count()
    if n <= complement_up_to:
        return ranked(non_edges(edges, ids), seed, "negative").where(F.col("rank") <= k)
    index = save(G.dense_rank_of(ids, "id"))
    spark = edges.sparkSession
    draws = 2 * k
    for _ in range(20):
        drawn = spark.range(draws).select("id", hashing.index(F.lit(n), seed, "u", "id").alias("iu"), hashing.index(F.lit(n), seed, "v", "id").alias("iv")).where("iu <> iv")
        named = drawn.join(index.toDF("a", "iu"), "iu").join(index.toDF("b", "iv"), "iv").select("id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        first = save(named.groupBy("u", "v").agg(F.min("id").alias("id")).join(edges, ["u", "v"], "left_anti"))
        if first.count() >= k or draws > 100 * k:
            break
        draws *= 2
    rank = G.dense_rank_of(first.select("id"), "id")
    return first.join(rank, "id").select("u", "v", (F.col("rank") + 1).alias("rank")).where(F.col("rank") <= k)


def labeled_pairs(edges: DataFrame, save, test: float = 0.15, val: float = 0.05, seed: int = 42, forest: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """(u, v, label, split): each split's edges and as many non-edges; negatives of test, val and train are disjoint."""
    if forest is None:
        forest = save(G.spanning_forest(edges, connected_components(edges, save), save))
    assigned = save(split_assign(edges, forest, save, test, val, seed))
    sizes = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.count("*").alias("n")).collect()}
    t, v = sizes.get("test", 0), sizes.get("val", 0)
    drawn = negative_sample(edges, sum(sizes.values()), save, seed)
    negatives = drawn.select("u", "v", F.lit(0).alias("label"), F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "val").otherwise("train").alias("split"))
    return assigned.select("u", "v", F.lit(1).alias("label"), "split").unionByName(negatives)


def split_metadata(edges: DataFrame, pairs: DataFrame, save) -> DataFrame:  # noqa: ANN001
    """One row: sizes of the splits, and whether the training graph is as connected as the whole."""
    train = pairs.where("split = 'train' and label = 1").select("u", "v")
    parts = connected_components(train, save).agg(F.countDistinct("component").alias("c"), F.count("*").alias("n"))
    n = G.nodes(edges).agg(F.count("*").alias("num_nodes"))
    size = lambda s, y: F.count(F.when((F.col("split") == s) & (F.col("label") == y), 1))
    out = pairs.agg(F.count(F.when(F.col("label") == 1, 1)).alias("total_edges"), size("train", 1).alias("train_edges"), size("test", 1).alias("test_positive_edges"), size("val", 1).alias("val_positive_edges"), size("test", 0).alias("test_negative_edges"), size("val", 0).alias("val_negative_edges"), size("train", 0).alias("train_negative_edges"))
    full = out.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(parts))  # one row each
    return full.select("num_nodes", *out.columns, ((F.col("c") == 1) & (F.col("n") == F.col("num_nodes"))).alias("is_train_connected"))
