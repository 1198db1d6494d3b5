import pytest
from pyspark.sql import functions as F

from weft.operators import embeddings as E
from weft.operators import evaluate as V
from weft.operators import graph as G
from weft.operators import models as M
from weft.sources import edges as src
from weft.sources.scratch import materialize


def save(df):
    return materialize(df, "test")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 2, 1, 0.9), (1, 3, 1, 0.5), (1, 4, 0, 0.5), (1, 5, 0, 0.1), (1, 6, 1, 0.1)]
    return spark.createDataFrame(rows, "u bigint, v bigint, label int, score double")


def test_rank_metrics(scored, spark):
    # Pairs won: 0.9 beats both; 0.5 ties one and beats one; 0.1 ties one and loses one.
    assert V.roc_auc(scored).first()[0] == pytest.approx((2 + 1.5 + 0.5) / 6)
    assert V.average_precision(scored).first()[0] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)
    assert tuple(V.confusion_matrix(scored).first()) == (1, 1, 1, 2)
    r = V.classification_metrics(scored).first()
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(2 / 3) and r["accuracy"] == pytest.approx(0.6)
    assert V.hits_at_k(scored, least=2).first()[0] == 1.0
    assert V.confusion_at_thresholds(scored).count() == 19
    assert V.roc_curve(scored).count() == 4 and V.pr_curve(scored).count() == 4
    assert V.roc_auc(scored.where("label = 1")).first()[0] is None
    board = V.leaderboard(scored.withColumn("model", F.lit("m"))).collect()
    assert board[0]["roc_auc"] == 0.6667


def test_scaling(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0), (float("inf"), 5.0)], "a double, b double")
    clean = M.clean_nonfinite(rows, ["a", "b"])
    assert [r["a"] for r in clean.collect()] == [1.0, 3.0, 0.0, 0.0]
    scale = M.fit_scale(clean, ["a", "b"])
    assert scale["b"] == (5.0, 1.0) and scale["a"][1] == pytest.approx(1.2247448)
    assert {r["b"] for r in M.standard_scale(clean, scale).collect()} == {0.0}
    assert "c" in M.align(clean, ["a", "c"]).columns


def test_models_learn(spark, tmp_path):
    rows = [(i, -i, int(i % 3 == 0), float(i % 3 == 0) + (i % 7) * 0.05, float(i % 5)) for i in range(90)]
    df = save(spark.createDataFrame(rows, "u int, v int, label int, x double, y double"))
    for model in (M.zoo(["x", "y"])["logistic_regression"], M.two_layer_net(["x", "y"], maxIter=60)):
        out = model.fit(df).transform(df).select("label", F.col("probability").alias("score"))
        assert V.roc_auc(out).first()[0] > 0.95
    lr = M.zoo(["x", "y"])["logistic_regression"].fit(df)
    assert M.importances(lr)[0][0] == "x"
    M.save_bundle({"lr": lr}, str(tmp_path / "m"))
    again = M.load_bundle(spark, str(tmp_path / "m"))[0]["lr"].transform(df).orderBy("u").collect()
    assert [r["probability"] for r in again] == [r["probability"] for r in lr.transform(df).orderBy("u").collect()]
    h = M.HeuristicScore("x").fit(df)
    assert h.transform(df.drop("x")).agg(F.max("probability")).first()[0] == 0.0


def test_embeddings(spark):
    k = save(src.karate(spark))
    w = save(E.walks(k, save, 2, 5))
    steps = w.toDF("start", "walk", "step", "a").join(w.select("start", "walk", (F.col("step") - 1).alias("step"), F.col("node").alias("b")), ["start", "walk", "step"])
    assert steps.count() == 34 * 2 * 4
    assert steps.join(G.adjacency(k).toDF("a", "b"), ["a", "b"], "left_anti").count() == 0
    c = save(E.cooccurrence(w))
    assert c.join(c.toDF("b", "a", "m"), ["a", "b"]).where("n <> m").count() == 0
    assert E.ppmi(c).where("ppmi <= 0").count() == 0
    z = save(E.node_embeddings(k, save, dim=4, per_node=2, length=5))
    assert z.count() == 34
    pairs = spark.createDataFrame([(0, 1), (0, 999)], "u bigint, v bigint")
    got = {r["v"]: r for r in E.edge_embedding_features(pairs, z, 4).collect()}
    assert got[1]["emb_l2_dist"] ** 2 == pytest.approx(2 - 2 * got[1]["emb_cosine_sim"], abs=1e-9)
    assert got[999]["emb_cosine_sim"] == 0 and got[999]["emb_dot_product"] == 0
    probs = E.transition_probs(k, 0.5, 2.0).groupBy("prev", "curr").agg(F.sum("prob").alias("s"))
    assert probs.where("abs(s - 1) > 1e-9").count() == 0


def test_leaderboard_takes_all_models_and_features(spark, graph, monkeypatch):
    from weft.plans import queries

    taken = {}

    def score_all(models, train, test):
        taken.update(models=set(models), columns=M.columns_of(models["random_forest"]) if "random_forest" in models else [], train=train)
        return test.select(F.lit("m").alias("model"), "u", "v", "label", F.lit(0.5).alias("score"))

    monkeypatch.setattr(queries, "suppliers", lambda spark, sf_dir: src.karate(spark))
    monkeypatch.setattr(M, "score_all", score_all)
    queries.leaderboard(spark, "").collect()
    assert taken["models"] == set(M.zoo(["x"])) and len(taken["models"]) == 11
    assert len(taken["columns"]) == 28 and set(taken["columns"]) <= set(taken["train"].columns)
    row = taken["train"].agg(*[F.count_distinct(c).alias(c) for c in taken["columns"]]).first()
    assert min(row[c] for c in ("pagerank_product", "closeness_product", "same_community", "emb_cosine_sim", "emb_hadamard_7")) > 1


def test_ranks_over_skewed_scores(spark):
    """Running sums by ranges equal those of one sorted list, with ties, nulls of a class, and one huge outlier."""
    import random

    from weft.operators import evaluate as V

    rng = random.Random(4)
    rows = [(k, k + 1, rng.randrange(2), rng.choice([1e12, -3.0, *(rng.random() for _ in range(9))])) for k in range(700)]
    scored = spark.createDataFrame(rows, "u bigint, v bigint, label int, score double")
    got = sorted((r["score"], r["tp"], r["fp"], r["p"], r["n"]) for r in V.by_score(scored).collect())
    p = sum(r[2] for r in rows)
    want = []
    for s in sorted({r[3] for r in rows}):
        above = [r[2] for r in rows if r[3] >= s]
        want.append((s, sum(above), len(above) - sum(above), p, len(rows) - p))
    assert got == want
    best = sorted(rows, key=lambda r: (-r[3], r[0], r[1]))[:70]
    assert V.hits_at_k(scored).first()[0] == sum(r[2] for r in best) / min(70, p)
    assert V.roc_auc(scored.limit(0)).first()[0] is None and not V.hits_at_k(scored.limit(0)).first()[0]


def test_fitted_model_keeps_raw_features(spark):
    from weft.operators import models as M

    rows = [(k, k + 1, k % 2, float(k % 2) * 10 + k % 3) for k in range(60)]
    train = spark.createDataFrame(rows, "u bigint, v bigint, label int, x double")
    out = M.zoo(["x"])["logistic_regression"].fit(train).transform(train)
    assert {(r["u"], r["x"]) for r in out.collect()} == {(r[0], r[3]) for r in rows}


def test_dense_rank_of_clustered_ids(spark):
    from weft.operators import graph as G

    ids = [*range(50), 10**15, 10**15 + 7, -(10**17)]
    got = {r["id"]: r["rank"] for r in G.dense_rank_of(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_candidates_are_filled(spark, graph):
    from weft.operators import serve as R

    edges = graph([(1, 2), (2, 3), *((10 + k, 11 + k) for k in range(40))])
    got = {}
    for r in R.candidates(edges, enough=20, most=25).collect():
        got.setdefault(r["user"], {})[r["candidate"]] = r["mutual"]
    assert got[1][3] == 1 and 1 not in got[1] and 2 not in got[1] and len(got[1]) == 25
    assert all(len(c) == 25 for c in got.values())
    nobody = spark.createDataFrame([(999,)], "id bigint")
    assert R.candidates(edges, nobody).count() == 0
