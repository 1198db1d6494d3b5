"""What the seventh look asked for: results that don't change their meaning with the size of the input."""

import numpy as np
import pytest

from weft.operators import analytics as A
from weft.operators import searches
from weft.sources.scratch import materialize


def save(df):
    return materialize(df, "test")


def ring(n, first=0):
    return [(first + k, first + k + 1) for k in range(n - 1)] + [(first, first + n - 1)]


def test_closeness_of_pairs_has_no_cutoff(spark, graph, tmp_path):
    """2,002 nodes: pair features took closeness as 0 beyond 2,000."""
    from weft.plans import queries

    edges = save(graph([(2 * k, 2 * k + 1) for k in range(1001)]))
    none = spark.createDataFrame([], "id bigint, community bigint")
    assert {round(r["closeness"], 12) for r in queries.node_stats(edges, none).collect()} == {round(1 / 2001, 12)}


def test_paths_of_large_graphs_are_not_sampled(graph):
    """A ring of 1,501 nodes: both were taken from a sample of nodes."""
    n = 1501
    edges = save(graph(ring(n)))
    assert tuple(A.path_lengths(edges, save).first()) == (pytest.approx((n + 1) / 4), n // 2)
    got = [r["betweenness"] for r in A.betweenness(edges, save).collect()]
    per_node = ((n - 1) // 2 - 1) * (n - 1) / 2 / ((n - 1) * (n - 2))
    assert len(got) == n and got == [pytest.approx(per_node)] * n


def test_batches_and_parts_of_a_search_make_no_difference(monkeypatch):
    links = [(a, b) for a in range(90) for b in range(a + 1, 90) if (a * b + a) % 17 == 1 or b == a + 1]
    whole = searches.Links(np.arange(90).tobytes(), np.array(links, np.int32).tobytes())
    sums, paths = list(searches.hops(16)(whole, np.arange(90))), next(searches.dependencies(whole, np.arange(90)))
    monkeypatch.setattr(searches, "CELLS", 1)
    monkeypatch.setattr(searches, "GATHERED", 1)
    parts = [list(searches.hops(16)(whole, np.arange(a, a + 30))) for a in (0, 30, 60)]
    assert [x.tolist() for x in sums] == [sum(p[k] for p in parts).tolist() if k < 2 else np.max([p[k] for p in parts], axis=0).tolist() for k in range(3)]
    assert np.allclose(paths, sum(next(searches.dependencies(whole, np.arange(a, a + 30))) for a in (0, 30, 60)))


def test_searches_in_shares_are_those_of_tables(graph, monkeypatch):
    monkeypatch.setattr(A, "HOP_WORK", 40)
    monkeypatch.setattr(A, "PATH_WORK", 40)
    pairs = [*ring(9), (0, 4), (2, 7), *ring(4, 100), (100, 102), (200, 201)]
    edges = save(graph(pairs))
    n = A.G.nodes(edges).count()
    tables = A._dependencies(edges, save, A.G.nodes(edges)).groupBy("id").agg({"delta": "sum"}).toDF("id", "b").collect()
    want = {r["id"]: r["b"] / ((n - 1) * (n - 2)) for r in tables}
    got = {r["id"]: r["betweenness"] for r in A.betweenness(edges, save).collect()}
    assert len(got) == n and all(got[k] == pytest.approx(want.get(k, 0.0)) for k in got)
    far = {r["src"]: r["x"] for r in A.distances(edges, save).groupBy("src").agg({"dist": "max"}).toDF("src", "x").collect()}
    assert {r["id"]: r["far"] for r in A.hop_sums(edges, save).collect()} == far


def test_greedy_communities_have_no_limit_of_edges(spark):
    """Two cliques of 450 nodes and a link, 202,051 edges: components of more than 200,000 were refused."""
    clique = spark.range(450).selectExpr("id AS u").crossJoin(spark.range(450).selectExpr("id AS v")).where("u < v")
    edges = save(clique.union(clique.selectExpr("u + 450", "v + 450")).union(spark.createDataFrame([(0, 450)], "u bigint, v bigint")))
    assert edges.count() == 202051
    got = A.greedy_communities(edges).groupBy("community").agg({"id": "min"}).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 450)]


def test_greedy_merges_are_those_of_the_plain_rule():
    rng = np.random.default_rng(3)
    for n in (5, 12, 25):
        links = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(3 * n)})
        m, parts = len(links) + 2, [{k} for k in sorted({x for e in links for x in e})]
        while True:
            best = None
            for a in range(len(parts)):
                for b in range(a + 1, len(parts)):
                    w = sum((u in parts[a] and v in parts[b]) or (u in parts[b] and v in parts[a]) for u, v in links)
                    ends = [sum((u in p) + (v in p) for u, v in links) for p in (parts[a], parts[b])]
                    key = (-(w / m - ends[0] * ends[1] / (2.0 * m * m)), min(parts[a]), min(parts[b]), a, b)
                    if w and -key[0] > 1e-15 and (best is None or key < best):
                        best = key
            if best is None:
                break
            parts[best[3]] |= parts.pop(best[4])
            parts.sort(key=min)
        assert sorted(map(sorted, A._agglomerate(links, m))) == sorted(map(sorted, parts))


def test_pairs_of_vectors_are_measured_side_by_side(spark, monkeypatch):
    """The sums were taken vector by vector in the plan; the pairs and their measures stay as they were."""
    from weft.operators import embeddings as E

    monkeypatch.setattr(E, "GROUP_PART", 4)
    rows = [(k, k % 3, [float(np.sin(k * j + 1)) for j in range(9)]) for k in range(40)] + [(40, 0, None), (41, 1, [0.5, None] + [1.0] * 7), (42, 1, [1.0]), (None, 0, [1.0] * 9)]
    vecs = save(spark.createDataFrame(rows, "id bigint, group int, z array<double>"))
    got = E.group_embedding_features(vecs, 9)
    assert "zip_with" not in got._jdf.queryExecution().executedPlan().toString()
    whole = [r for r in got.collect() if r["u"] not in (41, 42) and r["v"] not in (41, 42)]
    odd = [r for r in got.collect() if r["u"] in (41, 42) or r["v"] in (41, 42)]
    assert len(odd) == 13 * 2 + 1 and all(x is None for r in odd for x in r[2:])
    ids = [k for k in range(41)]
    pairs = save(spark.createDataFrame([(a, b) for a in ids for b in ids if a < b and (a % 3 if a < 40 else 0) == (b % 3 if b < 40 else 0)], "u bigint, v bigint"))
    want = E.edge_embedding_features(pairs, vecs.where("id <= 40").select("id", "z"), 9)
    assert sorted(map(tuple, whole)) == sorted(map(tuple, want.collect()))
    few = E.group_embedding_features(vecs, 9, columns=("emb_hadamard_1", "emb_l2_dist"), digits=3)
    rounded = {(r["u"], r["v"]): (round(r["emb_hadamard_1"], 3) + 0.0, round(r["emb_l2_dist"], 3)) for r in want.collect()}
    assert {(r[0], r[1]): (r[2], r[3]) for r in few.collect() if r[2] is not None} == rounded


def test_few_held_rows_are_summed_by_the_driver(spark, monkeypatch):
    """A pass over few rows was a job each; its sums are the same to the last bit."""
    from weft.functions import treesum
    from weft.operators.boosting import BoostedTrees
    from weft.operators.networks import Network

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    rows = save(spark.createDataFrame([(*map(float, r), int(r[0] + r[1] * r[2] > 0)) for r in x], "a double, b double, c double, label int").repartition(3))
    columns = ["a", "b", "c"]
    trees, net = BoostedTrees(columns, maxIter=10, maxDepth=3), Network(columns, hidden=[4], kinds=["relu"], maxIter=3)
    assert isinstance(treesum.held(rows), treesum.Local)
    local = trees.fit(rows).state(), net.fit(rows).state()
    monkeypatch.setattr(treesum, "LOCAL_BYTES", -1)
    assert not isinstance(treesum.held(rows), treesum.Local)
    assert (trees.fit(rows).state(), net.fit(rows).state()) == local


def test_measures_of_all_pairs_learn_what_they_read_only(spark, graph, monkeypatch):
    """PageRank's product and difference computed closeness as well; the smaller side was broadcast."""
    from weft.operators import features as X
    from weft.plans import queries

    monkeypatch.setattr(queries.A, "closeness", None)
    edges = save(graph([(0, 1), (1, 2), (2, 3), (0, 2)]))
    stats = save(queries.one_stat("pagerank_diff", edges, None))
    monkeypatch.setattr(X, "NODE_PART", 3)
    got = X.all_node_features(stats).select("u", "v", "pagerank_diff")
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    rank = {r["id"]: r["pagerank"] for r in stats.collect()}
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {(a, b): abs(rank[a] - rank[b]) for a in range(4) for b in range(a + 1, 4)}


def test_sketches_are_merged_in_tasks(spark, graph, monkeypatch):
    """Sketches were sent along every edge in every round; now none is written, in whatever shares registers are dealt."""
    from weft.sources import edges as src

    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df)

    edges = save(src.powerlaw_cluster(spark, 300, 3).union(graph([(1000, 1001), (1001, 1002)])))
    exact = {r["id"]: r for r in A.closeness(edges, save).join(A.hop_sums(edges, save), "id").collect()}
    whole = sorted(map(tuple, A.sketched_closeness(edges, watched).collect()))
    assert not any("hll" in p for p in plans)
    assert len(whole) == len(exact) == 303
    for k, closeness, reached, rounds in whole:
        assert closeness == pytest.approx(exact[k]["closeness"], rel=0.05) and reached == pytest.approx(exact[k]["r"], rel=0.05)
        assert rounds <= exact[k]["far"]
    monkeypatch.setattr(searches, "REGISTERS", 1 << 18)
    parts = sorted(map(tuple, A.sketched_closeness(edges, save).collect()))
    assert [p == (pytest.approx(w)) for p, w in zip(parts, whole)] == [True] * 303
