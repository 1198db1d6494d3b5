import math

import pytest
from pyspark.sql import functions as F

from weft.operators import analytics as A
from weft.operators import features as X
from weft.operators import graph as G
from weft.operators import serve as R
from weft.operators import split as S
from weft.operators.components import connected_components
from weft.sources import edges as src
from weft.sources.scratch import materialize

TRIANGLE = [(0, 1), (1, 2), (0, 2)]
PATH = [(0, 1), (1, 2), (2, 3)]
STAR = [(0, 1), (0, 2), (0, 3), (0, 4)]
TWO = [*TRIANGLE, (3, 4)]
K4 = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def save(df):
    return materialize(df, "test")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_parse_edges(spark):
    lines = ["", "# c", "% c", "source,target", "1;2", "1\t2", "1, 2, 0.5", "-1 2", "1.5 2", "3 3", "2 1", "7", " 4 5 "]
    got = src.parse_edges(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r) for r in got.collect()} == {(1, 2), (4, 5)}
    assert src.parse_edges(spark.createDataFrame([], "value string")).count() == 0


def test_read_edge_list(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n2 3\n")
    assert src.load_graph(spark, str(tmp_path / "g.txt")).count() == 2
    with pytest.raises(ValueError):
        src.load_graph(spark, "unknown")


def test_karate(spark):
    k = src.karate(spark)
    assert one(A.counts(k)) == (34, 78)
    assert G.dedup_undirected(k).count() == 78
    assert one(A.transitivity(k))[0] == pytest.approx(0.2556818, abs=1e-6)
    assert one(A.avg_clustering(k))[0] == pytest.approx(0.5706384, abs=1e-6)
    assert A.triangles(k).agg(F.sum("triangles")).first()[0] == 45 * 3
    parts = A.greedy_communities(k)
    q = one(A.modularity(k, parts))[0]
    assert 0.37 < q < 0.42 and parts.count() == 34


def test_generator_has_triangles(spark):
    g = save(src.powerlaw_cluster(spark, 200, 4))
    assert g.count() == G.dedup_undirected(g).count()
    assert one(A.counts(g))[0] == 200
    assert one(A.transitivity(g))[0] > 0.05


def test_components_and_forest(graph, spark):
    g = graph(TWO)
    labels = {r["id"]: r["component"] for r in connected_components(g, save).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    chain = graph([(i, i + 1) for i in range(70)] + [(100, 100), (None, 3)])
    found = {r["id"]: r["component"] for r in connected_components(chain, save).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 72
    forest = G.spanning_forest(g, save(connected_components(g, save)), save)
    assert forest.count() == 3
    assert {tuple(r) for r in G.largest_component(g, connected_components(g, save)).collect()} == set(TRIANGLE)
    assert connected_components(graph([]), save).count() == 0


def test_paths_and_centralities(graph):
    r = one(A.path_lengths(graph(PATH), save))
    assert r["diameter"] == 3 and r["avg_path_length"] == pytest.approx(10 / 6)
    assert one(A.path_lengths(graph(TWO), save)) == (None, None)
    between = {r["id"]: r["betweenness"] for r in A.betweenness(graph(STAR), save).collect()}
    assert between[0] == pytest.approx(1.0) and between[1] == 0
    close = {r["id"]: r["closeness"] for r in A.closeness(graph(TWO), save).collect()}
    assert close[0] == pytest.approx(0.5) and close[3] == pytest.approx(0.25)
    ranks = A.pagerank(graph(TWO), save).collect()
    assert sum(r["pagerank"] for r in ranks) == pytest.approx(1.0)


def test_closeness_query_has_no_cutoff(graph, spark, monkeypatch):
    from weft.plans import queries

    monkeypatch.setattr(queries, "suppliers", lambda spark, sf_dir: graph([(2 * k, 2 * k + 1) for k in range(1001)]))
    close = queries.closeness(spark, "").collect()
    assert len(close) == 2002
    assert {r["closeness"] for r in close} == {round(1 / 2001, 8)}


def test_isolated_and_empty(graph, spark):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (9,)], "id bigint")
    r = one(A.degree_stats(graph(TRIANGLE), nodes))
    assert r["min_degree"] == 0 and r["avg_degree"] == 1.5
    assert one(A.degree_distribution(graph(TRIANGLE)))["degree"] == 2
    assert one(A.power_law_fit(graph(TRIANGLE))) == (0.0, 0.0)
    assert one(A.graph_summary(graph([]), save)) == (0, 0)
    assert one(A.density(graph(K4)))[0] == 1.0
    ranks = {r["id"]: r["pagerank"] for r in A.pagerank(graph(TRIANGLE), save, nodes).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks[9] < ranks[0]


def test_features_agree(graph, spark):
    k = save(src.karate(spark))
    ids = G.nodes(k)
    pairs = save(ids.toDF("u").join(ids.toDF("v"), F.col("u") < F.col("v")))
    a = {(r["u"], r["v"]): r for r in X.local_features(k, pairs).collect()}
    b = {(r["u"], r["v"]): r for r in X.set_features(k, pairs).collect()}
    assert a.keys() == b.keys() and len(a) == 34 * 33 // 2
    for key, r in a.items():
        for c in X.LOCAL:
            assert r[c] == pytest.approx(b[key][c], abs=1e-12)
        assert 0 <= r["jaccard_coefficient"] <= r["sorensen_index"] <= 1
        assert r["hub_depressed_index"] <= r["salton_cosine"] + 1e-12 <= r["hub_promoted_index"] + 1e-9
    unknown = one(X.local_features(k, spark.createDataFrame([(77, 88)], "u bigint, v bigint")))
    assert all(unknown[c] == 0 for c in X.LOCAL)
    leaves = one(X.local_features(graph(STAR), spark.createDataFrame([(1, 2)], "u bigint, v bigint")))
    assert leaves["resource_allocation"] == 0.25 and leaves["adamic_adar"] == pytest.approx(1 / math.log(4))


def test_split(spark):
    k = save(src.karate(spark))
    pairs = save(S.labeled_pairs(k, save))
    meta = one(S.split_metadata(k, pairs, save))
    assert meta["total_edges"] == 78 and meta["test_positive_edges"] == 11 and meta["is_train_connected"]
    assert meta["train_negative_edges"] == meta["train_edges"]
    rows = [tuple(r) for r in pairs.select("u", "v", "label").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    assert {r[:2] for r in rows if r[2]} == {tuple(r) for r in k.collect()}
    assert S.split_counts(100, 10) == (5, 0)
    few = S.negative_sample(k, 5, save, complement_up_to=0)
    assert few.count() == 5 and few.join(k, ["u", "v"]).count() == 0
    assert S.negative_sample(spark.createDataFrame(K4, "u bigint, v bigint"), 5, save).count() == 0


def test_serving(graph, spark):
    g = graph([(0, 1), (0, 2), (3, 1), (3, 2), (4, 1)])
    score = lambda p: p.withColumn("probability", F.col("resource_allocation") / (1 + F.col("resource_allocation")))
    best = R.recommend(g, score, spark.createDataFrame([(0,), (99,)], "id bigint"), top=1).collect()
    assert [(r["user"], r["candidate_id"], r["mutual_friends"]) for r in best] == [(0, 3, [1, 2])]
    assert best[0]["explanation"] == "Has 2 mutual friends: 1, 2"
    change = one(R.what_if(g, 0, 4, 3, score))
    assert change["probability_change"] > 0
    assert one(R.what_if(g, 0, 4, 0, score))["probability_change"] == 0
    ego = G.k_hop_ego(g, 0, 1, save)
    assert {tuple(r) for r in ego.collect()} == {(0, 1), (0, 2)}
    assert G.bfs_sample(g, 3, 1, save).count() == 3
