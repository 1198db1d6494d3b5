"""Graph algorithms whose rows or rounds stay bounded, against exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import analytics as A
from weft.operators import embeddings as E
from weft.operators import graph as G
from weft.operators.communities import louvain
from weft.operators.components import connected_components
from weft.operators.forest import minimum_forest
from weft.sources import edges as src
from weft.sources.scratch import materialize


def save(df):
    return materialize(df, "test")


def find(parent, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def test_forest_of_a_long_path_takes_few_rounds(spark):
    n, rounds = 100_000, []
    path = save(spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert minimum_forest(path, save, on_round=rounds.append).count() == n - 1 and len(rounds) < 20


def test_forest_is_the_minimum_one(spark, graph):
    import hashlib

    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)} | {(100, 101), (101, 102), (100, 102)} | {(200, 200 + k) for k in range(1, 30)}
    edges = save(graph(sorted(pairs)))
    got = {tuple(r) for r in minimum_forest(edges, save).collect()}
    parent, want = {x: x for p in pairs for x in p}, set()
    for u, v in sorted(pairs, key=lambda e: hashlib.md5(f"42|forest|{e[0]}|{e[1]}".encode()).hexdigest()):
        a, b = find(parent, u), find(parent, v)
        if a != b:
            parent[a] = b
            want.add((u, v))
    assert got == want
    parts = connected_components(edges, save).select("component").distinct().count()
    assert len(got) == G.nodes(edges).count() - parts
    assert minimum_forest(edges.limit(0), save).count() == 0


def blocks(k, size, inside, across, seed=1):
    rng = random.Random(seed)
    n = k * size
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def test_communities_are_as_good_as_greedy_ones(spark, graph):
    for edges in (save(src.karate(spark)), save(graph(blocks(4, 15, 0.5, 0.03)))):
        found = louvain(edges, save)
        q = A.modularity(edges, found).first()[0]
        greedy = A.modularity(edges, A.greedy_communities(edges).select("id", "community")).first()[0]
        assert q >= 0.98 * greedy
        assert found.groupBy("community").agg(F.min("id").alias("m")).where("m <> community").count() == 0
    # Two cliques and a bridge are two communities; a graph without edges has none; pieces stay apart.
    cliques = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    edges = graph([*cliques, *((a + 10, b + 10) for a, b in cliques), (0, 10), (50, 51)])
    assert {r["id"]: r["community"] for r in louvain(edges, save).collect()} == {k: 0 for k in range(6)} | {k + 10: 10 for k in range(6)} | {50: 50, 51: 50}
    assert louvain(graph([(1, 2)]).limit(0), save).count() == 0


def test_sketched_closeness_is_near_the_exact_one(spark, graph):
    edges = save(graph([*blocks(3, 20, 0.2, 0.02), (500, 501), (501, 502)]))
    exact = {r["id"]: r["closeness"] for r in A.closeness(edges, save).collect()}
    found = {r["id"]: r for r in A.neighbourhood_closeness(edges, save).collect()}
    assert set(found) == set(exact)
    assert all(found[k]["closeness"] == pytest.approx(exact[k], rel=0.03) for k in exact)
    sizes = {r["component"]: r["n"] for r in connected_components(edges, save).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found[501]["reached"] == pytest.approx(sizes[500], rel=0.03) and found[501]["rounds"] == 1


def test_rejection_walks_follow_the_transition_probabilities(spark, graph):
    edges = save(graph([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5)]))
    steps = save(E.rejection_walks(edges, save, per_node=400, length=3, p=0.25, q=4.0, trials=2))
    assert steps.count() == 6 * 400 * 3
    line = steps.groupBy("start", "walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("w"))
    moves = line.select(F.col("w")[0]["node"].alias("prev"), F.col("w")[1]["node"].alias("curr"), F.col("w")[2]["node"].alias("next"))
    got = {(r["prev"], r["curr"], r["next"]): r["n"] for r in moves.groupBy("prev", "curr", "next").agg(F.count("*").alias("n")).collect()}
    total = {}
    for (a, b, _), n in got.items():
        total[a, b] = total.get((a, b), 0) + n
    for r in E.transition_probs(edges, 0.25, 4.0).collect():
        n = total[r["prev"], r["curr"]]
        expected = r["prob"] * n
        assert abs(got.get((r["prev"], r["curr"], r["next"]), 0) - expected) < 4 * (expected * (1 - r["prob"]) + 1) ** 0.5 + 1
    assert steps.join(steps.select("start", "walk", (F.col("step") - 1).alias("step"), F.col("node").alias("b")), ["start", "walk", "step"]).join(G.adjacency(edges).toDF("node", "b"), ["node", "b"], "left_anti").count() == 0


def matrix_of(entries, n):
    import numpy as np

    m = np.zeros((n, n))
    for r in entries.collect():
        m[r["a"], r["b"]] += r["value"]
    return m


def test_block_iteration_finds_singular_vectors(spark):
    import numpy as np

    from weft.operators import blocks as B

    rng = random.Random(5)
    rows = {(rng.randrange(40), rng.randrange(40)): rng.random() for _ in range(300)}
    entries = save(spark.createDataFrame([(a, b, v) for (a, b), v in rows.items()], "a bigint, b bigint, value double").repartition(12))
    m = matrix_of(entries, 40)
    found, values = B.singular(entries, 5, save, rounds=30, tolerance=1e-5)
    u = np.zeros((40, 5))
    for r in found.collect():
        u[r["id"]] = r["y"]
    want = np.linalg.svd(m)[1][:5]
    assert values == pytest.approx(want, rel=1e-3)
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-8
    assert np.linalg.norm(m @ m.T @ u - u * values**2, axis=0).max() < 0.02 * want[0] ** 2
    low_rank = save(spark.createDataFrame([(a, b, float((a + 1) * (b + 2))) for a in range(9) for b in range(9)], "a bigint, b bigint, value double"))
    found, values = B.singular(low_rank, 4, save)
    assert len(values) == 1 and len(found.first()["y"]) == 1


def test_spectral_residuals(spark):
    import numpy as np

    from weft.operators import blocks as B

    k = save(src.karate(spark))
    for low in (True, False):
        entries = save(E.laplacian(k, low))
        m = matrix_of(entries, 34)
        found, values, residual = B.leading_eigen(entries, 5, 2.0, save)
        assert values == pytest.approx(np.sort(np.linalg.eigvalsh(m))[::-1][:5], abs=1e-4) and residual < 2e-4
        y = np.zeros((34, 5))
        for r in found.collect():
            y[r["id"]] = r["y"]
        assert np.linalg.norm(m @ y - y * values, axis=0).max() < 1e-3
    z = E.spectral_embed(k, save, dim=4)
    assert z.count() == 34 and z.where(F.abs(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-9).count() == 0


def test_two_hop_features_equal_those_of_pairs(spark, graph, monkeypatch):
    from weft.operators import features as X

    edges = save(graph([*blocks(2, 15, 0.3, 0.1), *((500, 600 + k) for k in range(40)), (600, 700), (601, 700)]))
    want = sorted(tuple(r) for r in X.local_features(edges, X.two_hop_pairs(edges)).select("u", "v", *(F.round(c, 9) for c in X.LOCAL)).collect())
    for part in (1024, 7):
        monkeypatch.setattr(X, "PART", part)
        assert sorted(tuple(r) for r in X.two_hop_features(edges).select("u", "v", *(F.round(c, 9) for c in X.LOCAL)).collect()) == want
