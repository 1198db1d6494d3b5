"""What findings of the third round asked for: pairs that move once, sketches that are not broadcast, communities side by side."""

import re

from weft.operators import analytics as A
from weft.operators import embeddings as E
from weft.operators import features as X
from weft.sources.scratch import materialize


def save(df):
    return materialize(df, "test")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_two_hops_apart_are_not_dealt_again_by_their_ends(spark, graph):
    edges = save(graph([(0, k) for k in range(1, 9)] + [(1, 2), (2, 3)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not re.search(r"hashpartitioning\([uv]#\d+L?, \d+\)", plan(X.two_hop_features(edges).select("u", "v", "adamic_adar")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_are_not_broadcast(graph):
    plans = []

    def watched(df):
        plans.append(plan(df))
        return save(df)

    A.neighbourhood_closeness(save(graph([(k, k + 1) for k in range(5)])), watched)
    assert any("hll_union_agg" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans if "hll_union_agg" in p)


def test_greedy_communities_of_components_are_those_of_the_whole(graph):
    clique = lambda s, n: [(a, b) for a in range(s, s + n) for b in range(a + 1, s + n)]
    edges = save(graph([*clique(0, 4), *clique(10, 4), (3, 10), *clique(20, 5), *clique(30, 4), (40, 41)]))
    groups = {}
    for r in A.greedy_communities(edges, most_edges=13).collect():
        groups.setdefault(r["community"], []).append(r["id"])
    assert [sorted(groups[k]) for k in range(5)] == [[*range(20, 25)], [*range(4)], [*range(10, 14)], [*range(30, 34)], [40, 41]]


def test_pairs_of_a_group_never_move(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP_PART", 3)
    rows = [(k, k % 2 if k < 18 else None, [float(k), 1.0] if k != 5 else None) for k in range(20)]
    vecs = save(spark.createDataFrame(rows, "id bigint, group bigint, z array<double>"))
    got = E.group_embedding_features(vecs.where("group is not null"), 2)
    pairs = save(spark.createDataFrame([(a, b) for a in range(18) for b in range(a + 1, 18) if (b - a) % 2 == 0], "u bigint, v bigint"))
    want = E.edge_embedding_features(pairs, vecs.select("id", "z"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not re.search(r"hashpartitioning\([uv]#", plan(got))


def test_all_pairs_of_node_features_never_move(spark):
    stats = save(spark.createDataFrame([(k, k / 10, 1.0 / (k + 1), k % 3 if k < 8 else None) for k in range(10)], "id bigint, pagerank double, closeness double, community bigint"))
    got = X.all_node_features(stats)
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(a + 1, 10)], "u bigint, v bigint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, X.node_features(pairs, stats).collect()))
    assert "Exchange hashpartitioning" not in plan(got)
