"""Recommendations over a graph: candidates, ranking, explanations, what-if."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import graph as G
from weft.operators.allpairs import linked_features
from weft.operators.features import local_features
from weft.operators.models import align, clean_nonfinite, standard_scale


def candidates_2hop(edges: DataFrame, users: DataFrame | None = None, cap: int | None = 150) -> DataFrame:
    """(user, candidate, mutual): friends of friends that aren't friends, most mutual ones first, at most cap a user.

    users(id): by default all. Unknown users have none.
    """
    adj = G.adjacency(edges)
    mine = adj if users is None else adj.join(users.select(F.col("id").alias("src")), "src", "left_semi")
    found = mine.join(adj.toDF("dst", "candidate"), "dst").where("src <> candidate").groupBy(F.col("src").alias("user"), "candidate").agg(F.count("*").alias("mutual"))
    found = found.join(adj.toDF("user", "candidate"), ["user", "candidate"], "left_anti")
    if cap is None:
        return found
    return found.withColumn("_r", F.row_number().over(W.partitionBy("user").orderBy(F.desc("mutual"), "candidate"))).where(F.col("_r") <= cap).drop("_r")


def fill(edges: DataFrame, users: DataFrame, most: int = 150, seed: int = 42) -> DataFrame:
    """(user, candidate, place): up to `most` nodes chosen by MD5 for each of users(id) that aren't its neighbours.

    Users with at most 4 * most such nodes get of all of them those of least MD5. For others, draw j takes one of all
    nodes in order of their ids, and a node counts where it comes up first; four draws are made for each place, more
    by the share of nodes that are neighbours. A user's draws are one array, of which only the places' go on; it is
    as long as four times `most` or, for a hub, as its degree.
    """
    adj, deg = G.adjacency(edges), G.degree(edges)
    ids = G.dense_rank_of(G.nodes(edges), "id")
    total = ids.agg(F.count("*").alias("n"))
    known = users.select("id").distinct().join(deg, "id").crossJoin(F.broadcast(total))  # one row
    known = known.select(F.col("id").alias("user"), "n", (F.col("n") - 1 - F.col("d")).alias("rest"))
    near = adj.toDF("user", "dst").join(ids.toDF("dst", "rank"), "dst").groupBy("user").agg(F.collect_list("rank").alias("near"))
    own = ids.toDF("user", "rank")
    # A number of partitions keeps the few users, with much to draw, from being put together.
    dealt = known.where("rest > 0").join(near, "user").join(own, "user").repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "user")
    few = F.col("rest") <= 4 * most
    last = F.when(few, F.col("n") - 1).otherwise(4 * most * F.ceil(F.col("n") / F.greatest("rest", F.lit(1))) - 1)
    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda j: F.when(few, j).otherwise(hashing.index(F.col("n"), seed, "fill", "user", j)))
    # The first of equal draws stays, in order.
    left = F.array_except(drawn, F.concat("near", F.array("rank")))
    kept = dealt.select("user", few.alias("few"), F.posexplode(F.when(few, left).otherwise(F.slice(left, 1, most))).alias("j", "rank"))
    named = kept.join(ids, "rank").select("user", "few", "j", F.col("id").alias("candidate"))
    by_key = F.row_number().over(W.partitionBy("user").orderBy(hashing.key(seed, "fill", "user", "candidate")))
    ranked = named.where("few").select("user", "candidate", by_key.cast("bigint").alias("place")).where(F.col("place") <= most)
    return named.where("not few").select("user", "candidate", (F.col("j") + 1).cast("bigint").alias("place")).unionByName(ranked)


def candidates(edges: DataFrame, users: DataFrame | None = None, enough: int = 20, most: int = 150, seed: int = 42) -> DataFrame:
    """(user, candidate, mutual): friends of friends, at most `most`; users with under `enough` of them get drawn
    ones up to `most`, with mutual = 0 (a drawn friend of a friend counts once). Unknown users have none."""
    near = candidates_2hop(edges, users, most)
    known = (G.nodes(edges) if users is None else users.select("id").distinct().join(G.nodes(edges), "id", "left_semi")).toDF("user")
    held = near.groupBy("user").agg(F.count("*").alias("held"))
    short = known.join(held, "user", "left").select("user", F.coalesce("held", F.lit(0)).alias("held")).where(F.col("held") < enough)
    drawn = fill(edges, short.withColumnRenamed("user", "id"), most, seed)
    drawn = drawn.join(near.select("user", "candidate"), ["user", "candidate"], "left_anti").join(short, "user")
    place = F.row_number().over(W.partitionBy("user").orderBy("place"))
    drawn = drawn.withColumn("_r", place).where(F.col("_r") + F.col("held") <= most)
    return near.unionByName(drawn.select("user", "candidate", F.lit(0).cast("bigint").alias("mutual")))


def mutual_friends(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(u, v, ...) with the sorted list of their common neighbours."""
    adj = G.adjacency(edges)
    keys = pairs.select("u", "v").distinct()
    shared = keys.join(adj.toDF("u", "z"), "u").join(adj.toDF("v", "z"), ["v", "z"]).groupBy("u", "v").agg(F.sort_array(F.collect_list("z")).alias("mutual_friends"))
    return pairs.join(shared, ["u", "v"], "left").withColumn("mutual_friends", F.coalesce("mutual_friends", F.array().cast("array<bigint>")))


def explanation(mutual: Column) -> Column:
    """A sentence on the mutual friends: up to four by name, the others counted."""
    n = F.size(mutual)
    some = F.array_join(F.transform(F.slice(mutual, 1, 4), lambda x: x.cast("string")), ", ")
    more = F.when(n > 4, F.concat(F.lit(" and "), (n - 4).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 0, F.concat(F.lit("Has "), n.cast("string"), F.when(n == 1, " mutual friend: ").otherwise(" mutual friends: "), some, more)).otherwise("No mutual friends: suggested by position in the graph")


def recommend(
    edges: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    users: DataFrame | None = None,
    top: int = 10,
    full_graph: DataFrame | None = None,
    cap: int = 150,
    enough: int = 20,
    features: Callable[[DataFrame, DataFrame], DataFrame] = local_features,
) -> DataFrame:
    """The best `top` candidates of each user, scored all at once.

    score: takes candidate pairs(u, v) with features(edges, pairs) and adds probability: a fitted model's transform,
    or a formula. Rank is by probability to four places, then candidate. Mutual friends come from full_graph, by
    default edges. Users with under `enough` friends of friends get drawn candidates.
    """
    pairs = candidates(edges, users, enough, cap).select(F.col("user").alias("u"), F.col("candidate").alias("v"))
    scored = score(features(edges, pairs)).withColumn("probability", F.round("probability", 4))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("probability"), "v"))).where(F.col("rank") <= top)
    named = mutual_friends(edges if full_graph is None else full_graph, best)
    return named.select(
        F.col("u").alias("user"),
        F.col("v").alias("candidate_id"),
        F.col("rank").cast("bigint").alias("rank"),
        "probability",
        F.size("mutual_friends").cast("bigint").alias("mutual_friends_count"),
        "mutual_friends",
        "common_neighbors",
        "jaccard_coefficient",
        "adamic_adar",
        "resource_allocation",
        explanation(F.col("mutual_friends")).alias("explanation"),
    )


def transform_pairs(edges: DataFrame, pairs: DataFrame, columns: list[str], scale: dict[str, tuple[float, float]], features: Callable[[DataFrame, DataFrame], DataFrame] = local_features) -> DataFrame:
    """pairs(u, v) with their features as they are, and scaled as a model was fitted on them (scaled_<name>)."""
    raw = clean_nonfinite(align(features(edges, pairs), columns), columns)
    scaled = standard_scale(raw, scale).select("u", "v", *[F.col(c).alias(f"scaled_{c}") for c in columns])
    return raw.select("u", "v", *columns).join(scaled, ["u", "v"])


def analyze_pairs(edges: DataFrame, pairs: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Connection, probability, prediction (from 0.5) and mutual friends of pairs(u, v)."""
    scored = score(local_features(edges, G.has_edge(edges, pairs)))
    return analyzed(mutual_friends(edges, scored))


def analyzed(scored: DataFrame) -> DataFrame:
    """The columns of analyze_pairs from (u, v, connected, probability, mutual_friends)."""
    return scored.select(F.col("u").alias("user_u"), F.col("v").alias("user_v"), F.col("connected").alias("already_connected"), "probability", (F.col("probability") >= 0.5).alias("predicted_link"), F.round(F.col("probability") * 100, 2).alias("confidence_score"), F.size("mutual_friends").cast("bigint").alias("mutual_friends_count"), "mutual_friends")


def pair_matrix(edges: DataFrame, ids: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v, probability, connected) for all ordered pairs of a slice of nodes; the diagonal is null."""
    a, b = ids.select(F.col("id").alias("u")), ids.select(F.col("id").alias("v"))
    pairs = a.join(b, F.col("u") != F.col("v"))
    return _with_diagonal(score(local_features(edges, G.has_edge(edges, pairs))), ids)


def whole_matrix(edges: DataFrame, score: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same for all nodes of the graph, for scores of local features: each pair is scored once and never moves."""
    scored = score(linked_features(edges, save))
    turned = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return _with_diagonal(scored.select("probability", "connected", turned), G.nodes(edges))


def _with_diagonal(scored: DataFrame, ids: DataFrame) -> DataFrame:
    scored = scored.select("u", "v", "probability", "connected")
    return scored.unionByName(ids.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("connected")))


def radar_profile(features: DataFrame) -> DataFrame:
    """Six features of pairs scaled to [0, 1] and clipped; emb_cosine_sim counts as 0 if absent."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    cosine = F.col("emb_cosine_sim") if "emb_cosine_sim" in features.columns else F.lit(0.0)
    return features.select("u", "v", clip(F.col("common_neighbors") / 10.0).alias("r_common"), clip(F.col("adamic_adar") / 4.0).alias("r_adamic"), clip(F.col("jaccard_coefficient") * 2.0).alias("r_jaccard"), clip(F.col("resource_allocation") * 3.0).alias("r_allocation"), clip(F.col("preferential_attachment") / 2000.0).alias("r_attachment"), clip((cosine + 1.0) / 2.0).alias("r_cosine"))


def what_if(edges: DataFrame, u: int, v: int, k: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Probability and Adamic-Adar of (u, v) before and after adding k common friends, on the same graph."""
    pair = edges.sparkSession.createDataFrame([(u, v)], "u bigint, v bigint")
    before = score(local_features(edges, pair)).select("u", "v", F.col("probability").alias("p0"), F.col("adamic_adar").alias("a0"))
    after = score(local_features(G.what_if_edges(edges, u, v, k), pair)).select("u", "v", F.col("probability").alias("p1"), F.col("adamic_adar").alias("a1"))
    return before.join(after, ["u", "v"]).select("u", "v", F.col("p0").alias("base_probability"), F.col("p1").alias("new_probability"), (F.col("p1") - F.col("p0")).alias("probability_change"), (F.col("a1") - F.col("a0")).alias("adamic_adar_change"))
