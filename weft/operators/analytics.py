"""Global analytics of a graph: counts, clustering, paths, centralities, communities, degree laws.

nodes: a table of ids where isolated nodes count; by default the end points of edges.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import hashing
from weft.operators import graph as G
from weft.operators import searches as S
from weft.operators.components import connected_components
from weft.sources.scratch import materialize, release

Save = Callable[[DataFrame], DataFrame]


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, d), isolated nodes with 0."""
    deg = G.degree(edges)
    return deg if nodes is None else nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("bigint").alias("d"))


def counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, nodes).agg(F.count("*").alias("num_nodes"), F.coalesce(F.floor(F.sum("d") / 2), F.lit(0)).cast("bigint").alias("num_edges"))


def degree_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return degrees(edges, nodes).agg(F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    n, m = F.col("num_nodes"), F.col("num_edges")
    return counts(edges, nodes).select(F.when(n > 1, 2.0 * m / F.when(n > 1, n * (n - 1))).otherwise(0.0).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of nodes in any.

    Edges point from the end of lower (degree, id) to the higher one, so a hub's wedges are those among
    its few neighbours of higher degree.
    """
    deg = G.degree(edges)
    both = edges.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
    up = both.select(F.when((F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v"))), F.struct(F.col("u").alias("a"), F.col("v").alias("b"))).otherwise(F.struct(F.col("v").alias("a"), F.col("u").alias("b"))).alias("e")).select("e.a", "e.b")
    wedges = up.join(up.withColumnRenamed("b", "c"), "a").where("b < c")
    closed = wedges.join(edges.toDF("b", "c"), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def local_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, d, triangles, clustering): 2 T / (d (d - 1)), 0 below degree 2."""
    d = F.col("d")
    full = degrees(edges, nodes).join(triangles(edges), "id", "left").select("id", "d", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))
    return full.withColumn("clustering", F.when(d > 1, 2.0 * F.col("triangles") / F.when(d > 1, d * (d - 1))).otherwise(0.0))


def avg_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return local_clustering(edges, nodes).agg(F.avg("clustering").alias("avg_clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Triangles' corners by connected triples."""
    t = local_clustering(edges).agg(F.sum("triangles").alias("t"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("w"))
    return t.select(F.when(F.col("w") > 0, F.col("t") / F.when(F.col("w") > 0, F.col("w"))).otherwise(0.0).alias("transitivity"))


def distances(edges: DataFrame, save: Save, sources: DataFrame | None = None) -> DataFrame:
    """(src, id, dist) from the sources, by default from all nodes: for graphs where n * n rows are few."""
    return G.bfs_levels(edges, G.nodes(edges) if sources is None else sources, save)


def path_lengths(edges: DataFrame, save: Save, exact_up_to: int | None = None, samples: int = 150, seed: int = 42) -> DataFrame:
    """avg_path_length and diameter (null where the graph isn't connected), exact at any size.

    With exact_up_to, larger graphs take distances from `samples` nodes by MD5; then the diameter is a lower bound.
    """
    ids = save(G.nodes(edges))
    n = ids.count()
    sampled = exact_up_to is not None and n > exact_up_to
    k = min(n, samples) if sampled else n
    if sampled:
        chosen = ids.orderBy(hashing.key(seed, "path", "id"), "id").limit(samples)
        found = distances(edges, save, chosen).agg(F.sum("dist").alias("s"), F.max("dist").alias("x"), F.count("*").alias("c"))
    else:
        found = hop_sums(edges, save).agg(F.sum("s").alias("s"), F.max("far").alias("x"), F.sum("r").alias("c"))
    whole = F.col("c") == k * n
    return found.select(F.when(whole & F.lit(n > 1), F.col("s") / F.lit(float(max(k * (n - 1), 1)))).alias("avg_path_length"), F.when(whole, F.col("x")).cast("bigint").alias("diameter"))


#: Words of 64 nodes that one pass of a search looks at side by side.
WORDS = 16
#: Nodes times edges of a component that make a share of its searches: of distances, of shortest paths.
HOP_WORK, PATH_WORK = 1 << 33, 1 << 28


def hop_sums(edges: DataFrame, save: Save) -> DataFrame:
    """(id, s, r, far): the sum of distances to all nodes that a node reaches, their number, itself included, and the
    largest distance; exact. What is written grows with nodes and edges (see `searches`), never with pairs of nodes."""
    found = save(S.searched(edges, save, S.hops(WORDS), "s bigint, r bigint, far bigint", S.by_work(HOP_WORK)))
    return found.groupBy("id").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.max("far").alias("far"))


def closeness(edges: DataFrame, save: Save, nodes: DataFrame | None = None, most_nodes: int | None = None) -> DataFrame:
    """(id, closeness): reachable share over mean distance (Wasserman and Faust), exact; with most_nodes 0 for all beyond so many nodes."""
    ids = save(G.nodes(edges) if nodes is None else nodes.select("id").distinct())
    n = ids.count()
    if most_nodes is not None and n > most_nodes:
        return ids.withColumn("closeness", F.lit(0.0))
    far = hop_sums(edges, save)
    value = F.when(F.col("s") > 0, ((F.col("r") - 1) / F.when(F.col("s") > 0, F.col("s"))) * ((F.col("r") - 1) / F.lit(float(max(n - 1, 1))))).otherwise(0.0)
    return ids.join(far, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def neighbourhood_closeness(edges: DataFrame, save: Save, precision: int = 12, most_rounds: int = 1 << 20) -> DataFrame:
    """(id, closeness, reached, rounds): approximate closeness on graphs of any size, by sketches of neighbourhoods.

    Every node holds a HyperLogLog sketch of the nodes within t hops; a round merges it with its neighbours' sketches,
    until no estimate grows. Rows are nodes and edges, never pairs of nodes; the rounds are those of the diameter.
    Young sketches take little room on disk and much in memory, so joins with them are never broadcast.
    The sum of distances is that over t of the nodes that aren't within t hops. The standard error of a count is
    0.83 / sqrt(2 ** precision): 1.3 % by default.
    """
    adj = save(G.adjacency(edges).union(G.nodes(edges).select("id", F.col("id").alias("dst"))).toDF("id", "near"))
    n = G.nodes(edges).count()
    now = save(G.nodes(edges).groupBy("id").agg(F.hll_sketch_agg("id", precision).alias("s")).select("id", "s", F.lit(1.0).alias("c"), F.lit(0.0).alias("far"), F.lit(0).alias("t")))
    for t in range(1, most_rounds):
        merged = adj.join(now.select(F.col("id").alias("near"), "s").hint("merge"), "near").groupBy("id").agg(F.hll_union_agg("s").alias("m"))
        size = F.hll_sketch_estimate("m").cast("double")
        new = merged.join(now.drop("s").hint("merge"), "id").select("id", F.col("m").alias("s"), F.greatest(size, F.col("c")).alias("c"), (F.col("far") + t * F.greatest(size - F.col("c"), F.lit(0.0))).alias("far"), F.when(size > F.col("c"), t).otherwise(F.col("t")).alias("t"))
        before, now = now, save(new)
        release(edges.sparkSession, before)  # a round is read by the next one only
        if now.where(F.col("t") == t).isEmpty():
            break
    return _of_sketches(now, n)


def _of_sketches(found: DataFrame, n: int) -> DataFrame:
    value = F.when(F.col("far") > 0, (F.col("c") - 1) / F.when(F.col("far") > 0, F.col("far")) * ((F.col("c") - 1) / F.lit(float(max(n - 1, 1))))).otherwise(0.0)
    return found.select("id", value.alias("closeness"), F.col("c").alias("reached"), F.col("t").alias("rounds"))


def sketched_closeness(edges: DataFrame, save: Save, precision: int = 12) -> DataFrame:
    """The same as neighbourhood_closeness, with the sketches in tasks (see `searches.sketches`): no sketch is ever
    written, only what a node's estimate changes by in a round, once for each share of the registers. A component of n
    nodes has n * 2 ** precision / 2 ** 26 shares. The hash and the estimator are others, the error is the same."""
    steps = save(S.searched(edges, save, S.sketches(precision), S.STEPS, S.slices(precision), 1 << precision))
    return _of_sketches(S.estimated(steps, precision), G.nodes(edges).count())


def pagerank(edges: DataFrame, save: Save, nodes: DataFrame | None = None, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank): power iteration from the uniform vector, dangling mass spread evenly.

    Ends after `rounds`, or when the L1 change falls below n * tolerance (0: never).
    """
    deg = save(degrees(edges, nodes))
    adj = save(G.adjacency(edges))
    n = deg.count()
    if not n:
        return deg.select("id", F.lit(0.0).alias("pagerank"))
    rank = deg.select("id", "d", F.lit(1.0 / n).alias("pagerank"))
    for k in range(rounds):
        sent = rank.where("d > 0").select(F.col("id").alias("src"), (F.col("pagerank") / F.col("d")).alias("x")).join(adj, "src").groupBy("dst").agg(F.sum("x").alias("x"))
        lost = rank.where("d = 0").agg(F.sum("pagerank").alias("lost"))
        base = (1.0 - alpha) / n + alpha * F.coalesce("lost", F.lit(0.0)) / n
        joined = rank.join(sent.withColumnRenamed("dst", "id"), "id", "left").crossJoin(F.broadcast(lost))  # one row
        fresh = joined.select("id", "d", F.col("pagerank").alias("old"), (base + alpha * F.coalesce("x", F.lit(0.0))).alias("pagerank"))
        if tolerance > 0:
            fresh = save(fresh)
            if fresh.agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0] < n * tolerance:
                rank = fresh.drop("old")
                break
        elif k % 4 == 3:
            fresh = save(fresh)
        rank = fresh.drop("old")
    return rank.select("id", "pagerank")


def betweenness(edges: DataFrame, save: Save, exact_up_to: int | None = None, pivots: int = 100, seed: int = 42) -> DataFrame:
    """(id, betweenness), normalised for undirected graphs, exact at any size: Brandes' dependencies of all sources, summed.

    With exact_up_to, larger graphs take `pivots` sources by MD5, rescaled.
    """
    ids = save(G.nodes(edges))
    n = ids.count()
    k = n if exact_up_to is None or n <= exact_up_to else min(pivots, n)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / k if k else 1.0)
    if k == n:
        total = save(S.searched(edges, save, S.dependencies, "delta double", S.by_work(PATH_WORK)))
    else:
        total = _dependencies(edges, save, ids.orderBy(hashing.key(seed, "between", "id"), "id").limit(k))
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    summed = total.groupBy("id").agg(F.sum("delta").alias("b"))
    return ids.join(summed, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(edges: DataFrame, save: Save, sources: DataFrame) -> DataFrame | None:
    """(id, delta) of few sources, in tables: one round a level for all sources, up with the counts of shortest paths and
    down with the dependencies. Rows: sources times nodes."""
    adj = save(G.adjacency(edges))
    dist = save(G.bfs_levels(edges, sources, save))
    top = dist.agg(F.max("dist")).first()[0] or 0
    levels = [save(dist.where("dist = 0").select("src", "id", F.lit(1.0).alias("sigma")))]
    for level in range(1, top + 1):
        came = levels[-1].withColumnRenamed("id", "at").join(adj.toDF("at", "id"), "at").groupBy("src", "id").agg(F.sum("sigma").alias("sigma"))
        levels.append(save(came.join(dist.where(F.col("dist") == level).select("src", "id"), ["src", "id"], "left_semi")))
    below, total = None, None
    for level in range(top, 0, -1):
        here = levels[level]
        here = here.withColumn("delta", F.lit(0.0)) if below is None else here.join(below, ["src", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        here = save(here)
        total = here.select("id", "delta") if total is None else total.unionByName(here.select("id", "delta"))
        share = here.select("src", F.col("id").alias("at"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("share")).join(adj.toDF("at", "id"), "at")
        parents = share.join(levels[level - 1], ["src", "id"])
        below = parents.groupBy("src", "id").agg(F.sum(F.col("share") * F.col("sigma")).alias("delta"))
    return total


def degree_centrality(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    deg = degrees(edges, nodes)
    total = deg.agg(F.count("*").alias("n"))
    return deg.crossJoin(F.broadcast(total)).select("id", F.when(F.col("n") > 1, F.col("d") / F.when(F.col("n") > 1, F.col("n") - 1)).otherwise(1.0).alias("degree_centrality"))  # one row


def node_centralities(edges: DataFrame, save: Save, limit: int | None = None, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node_id, degree and four centralities, by PageRank downwards; limit keeps the first rows."""
    out = G.degree(edges).join(degree_centrality(edges), "id").join(pagerank(edges, save, rounds=rounds, tolerance=tolerance), "id").join(betweenness(edges, save), "id").join(closeness(edges, save), "id")
    out = out.select(F.col("id").alias("node_id"), F.col("d").alias("degree"), "degree_centrality", "pagerank", F.col("betweenness").alias("betweenness_centrality"), F.col("closeness").alias("closeness_centrality")).orderBy(F.desc("pagerank"), "node_id")
    return out if limit is None else out.limit(limit)


def degree_distribution(edges: DataFrame) -> DataFrame:
    """degree, count and probability over nodes with an edge; by degree."""
    hist = G.degree(edges).groupBy(F.col("d").alias("degree")).agg(F.count("*").alias("count"))
    return hist.withColumn("probability", F.col("count") / F.sum("count").over(W.partitionBy())).orderBy("degree")


def power_law_fit(edges: DataFrame) -> DataFrame:
    """gamma and r squared of a line through (ln k, ln P); zeros with two degrees or fewer."""
    x, y = F.log(F.col("degree").cast("double")), F.log("probability")
    fit = degree_distribution(edges).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.corr(x, y).alias("r"))
    many = F.col("n") > 2
    return fit.select(F.when(many, -F.col("s")).otherwise(0.0).alias("power_law_gamma"), F.when(many, F.col("r") * F.col("r")).otherwise(0.0).alias("r_squared"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Q of labels(id, community): sum over communities of L / m - (K / 2m) squared."""
    at = edges.join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v")
    inner = at.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("l"))
    ends = at.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    m = edges.agg(F.count("*").alias("m"))
    each = ends.join(inner, "c", "left").crossJoin(F.broadcast(m))  # one row
    return each.agg(F.coalesce(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("k") / (2.0 * F.col("m"))) * (F.col("k") / (2.0 * F.col("m")))), F.lit(0.0)).alias("modularity"))


def num_communities(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("community").alias("num_communities"))


def greedy_communities(edges: DataFrame, most_edges: int | None = None, save: Save = lambda df: materialize(df, "graph")) -> DataFrame:
    """(id, community) by greedy modularity maximisation (Clauset, Newman and Moore 2004), larger communities first.

    Only linked communities merge, and a gain depends on the two and on the number of all edges, so components are
    agglomerated side by side with the same result. Within one it is sequential, in one task that holds the component's
    links; with most_edges a component of more is refused. Ties: the least pair of community ids merges.
    """
    m = edges.count()
    placed = save(edges.join(connected_components(edges, save).toDF("u", "component"), "u").select("u", "v", "component"))
    largest, parts = placed.groupBy("component").count().agg(F.max("count"), F.count("*")).first()
    if most_edges is not None and (largest or 0) > most_edges:
        raise ValueError("too many edges for one task: use louvain or label_propagation")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = _agglomerate(list(zip(pdf.u.tolist(), pdf.v.tolist())), m)
        return pd.DataFrame([(i, min(x), len(x)) for x in groups for i in x], columns=["id", "least", "size"])

    # The rows are few and the work isn't: a number of partitions keeps them from being put together.
    dealt = placed.repartition(max(1, min(parts, 1024)), "component")
    found = save(dealt.groupBy("component").applyInPandas(lambda pdf: run(pdf), "id bigint, least bigint, size bigint"))
    # Numbers from 0 by size downwards, then least member: a size's communities come after all larger ones.
    groups = found.where("id = least").select("least", "size")
    sizes = groups.groupBy("size").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a size
    inside = F.row_number().over(W.partitionBy("size").orderBy("least")) - 1
    named = groups.withColumn("_i", inside).join(sizes.select("size", before.alias("_before")), "size").select("least", (F.col("_before") + F.col("_i")).cast("bigint").alias("community"))
    return found.join(named, "least").select("id", "community")


def _agglomerate(links: list[tuple[int, int]], m: int) -> list[list[int]]:
    """Communities of one component's links; m: the number of edges of the whole graph.

    The heap has each two linked communities once, by a gain that they had: a community that grows loses gain with all
    but those that its new part was linked to, so only these are entered again, and others when their turn comes. Of two
    that merge, the one with more links takes the other's in, and keeps its place; its id is the less of both.
    """
    import heapq

    place: dict[int, int] = {}
    for u, v in links:
        place.setdefault(u, len(place))
        place.setdefault(v, len(place))
    ids = list(place)
    near: list[dict[int, int] | None] = [{} for _ in ids]
    for u, v in links:
        a, b = place[u], place[v]
        near[a][b] = near[b][a] = 1
    ends, members = [len(x) for x in near], [[i] for i in ids]

    def entry(a: int, b: int) -> tuple[float, int, int, int, int]:
        if ids[a] > ids[b]:
            a, b = b, a
        return -(near[a][b] / m - ends[a] * ends[b] / (2.0 * m * m)), ids[a], ids[b], a, b

    heap = [entry(a, b) for a, x in enumerate(near) for b in x if a < b]
    heapq.heapify(heap)
    while heap:
        top = heap[0]
        a, b = top[3:]
        if near[a] is None or near[b] is None or b not in near[a]:
            heapq.heappop(heap)
            continue
        now = entry(a, b)
        if now != top:
            heapq.heapreplace(heap, now)
            continue
        heapq.heappop(heap)
        if -now[0] <= 1e-15:
            break
        if len(near[a]) < len(near[b]):
            a, b = b, a
        ids[a] = min(ids[a], ids[b])
        ends[a] += ends[b]
        members[a] += members[b]
        del near[a][b]
        moved, near[b], members[b] = near[b], None, []
        for c, x in moved.items():
            if c != a:
                del near[c][b]
                near[a][c] = near[c][a] = near[a].get(c, 0) + x
        for c in moved:
            if c != a:
                heapq.heappush(heap, entry(a, c))
    return [x for x in members if x]


def label_propagation(edges: DataFrame, save: Save, rounds: int = 10) -> DataFrame:
    """(id, community): each node takes its neighbours' most frequent label, of equal ones the least; fixed rounds."""
    adj = save(G.adjacency(edges))
    labels = G.nodes(edges).withColumn("community", F.col("id"))
    for _ in range(rounds):
        seen = adj.join(labels.toDF("src", "c"), "src").groupBy("dst", "c").agg(F.count("*").alias("n"))
        labels = save(seen.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(-F.col("n"), F.col("c").alias("c"))).alias("b")).select("id", F.col("b.c").alias("community")))
    return labels


def graph_summary(edges: DataFrame, save: Save, communities: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row: size, degrees, clustering, components, path lengths and community structure."""
    edges = save(edges)
    if edges.isEmpty():
        return counts(edges)
    labels = save(communities(edges) if communities else greedy_communities(edges, save=save))
    parts = connected_components(edges, save).agg(F.countDistinct("component").alias("num_components")).withColumn("is_connected", F.col("num_components") == 1)
    out = counts(edges)
    for part in (density(edges), degree_stats(edges), avg_clustering(edges), transitivity(edges), parts, path_lengths(edges, save), modularity(edges, labels), num_communities(labels)):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
