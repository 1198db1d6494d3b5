"""Boosting split by split, networks against one process, and bundles."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from weft.functions.treesum import per_task, tree_sum
from weft.operators import boosting, networks
from weft.operators import models as M
from weft.sources.scratch import materialize


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.fixture(scope="module")
def table(spark):
    """5,000 rows whose label is an interaction of two features, with ties, noise, a constant and a dirty column."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 4)).round(2)
    x[:, 3] = rng.integers(0, 4, 5000)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(5000) < 0.1)).astype(int)
    rows = [(k, -k, int(y[k]), *map(float, x[k]), 1.0, None if k % 3 else float("nan")) for k in range(5000)]
    df = materialize(spark.createDataFrame(rows, "u int, v int, label int, a double, b double, c double, d double, e double, f double").repartition(7), "learners")
    return df, np.c_[x, np.ones(5000), np.zeros(5000)], y


NAMES = list("abcdef")


def plain_tree(bins, g, h, depth, leaves, l2, least_h, least_rows):
    """Splits (path, feature, bin) and leaf values by splitting one leaf after the other, sums over rows."""
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2 + 1e-16)

    def best(m):
        found = (1e-12, None)
        for f in range(bins.shape[1]):
            for b in range(int(bins[:, f].max())):
                low, high = m & (bins[:, f] <= b), m & (bins[:, f] > b)
                if min(low.sum(), high.sum()) >= max(least_rows, 1) and min(h[low].sum(), h[high].sum()) >= least_h:
                    x = (gain(low) + gain(high) - gain(m)) / 2
                    if x > found[0] + 1e-7:
                        found = (x, (f, b, low, high))
        return found

    everything = np.ones(len(g), bool)
    open_, splits, values = [("", everything, best(everything))], [], {}
    while open_ and (not leaves or len(splits) < leaves - 1):
        k = max(range(len(open_)), key=lambda i: open_[i][2][0])
        if open_[k][2][1] is None:
            break
        path, _, (_, (f, b, low, high)) = open_.pop(k)
        splits.append((path, f, b))
        for side, m in (("l", low), ("r", high)):
            open_.append((path + side, m, best(m) if len(path) + 1 < depth else (0.0, None)))
    for path, m, _ in open_:
        values[path] = -g[m].sum() / (h[m].sum() + l2 + 1e-16)
    return splits, values


def paths(tree):
    splits, values, at = [], {}, [(0, "")]
    while at:
        node, path = at.pop()
        if tree.feature[node] < 0:
            values[path] = tree.value[node]
        else:
            splits.append((path, tree.feature[node], tree.bin[node]))
            at += [(tree.left[node], path + "l"), (tree.right[node], path + "r")]
    return splits, values


@pytest.mark.parametrize("leaves", [0, 7])
def test_trees_equal_plain_ones(table, leaves):
    df, x, y = table
    kind = {"maxLeaves": leaves, "regLambda": 0.0, "minHessian": 1e-3, "minRows": 20} if leaves else {"regLambda": 1.0, "minHessian": 1.0}
    model = boosting.BoostedTrees(NAMES, maxIter=10, maxDepth=4, maxBins=12, stepSize=0.3, **kind).fit(df)
    state = model.state()
    bins = boosting.binned(x, [np.array(c) for c in state["cuts"]])
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    assert state["first"] == pytest.approx(score[0])
    for k, tree in enumerate(model.trees()):
        p = 1 / (1 + np.exp(-score))
        if k in (0, 1, 9):  # 9: after the blocks were written again
            splits, values = plain_tree(bins, p - y, p * (1 - p), 4, leaves, kind["regLambda"], kind["minHessian"], kind.get("minRows", 1))
            got, found = paths(tree)
            assert sorted(got) == sorted(splits)
            assert found == pytest.approx(values, abs=1e-6)
        score = score + 0.3 * tree.scores(bins)
    got = {r["u"]: r["probability"] for r in model.transform(df).select("u", "probability").collect()}
    assert np.allclose([got[k] for k in range(5000)], 1 / (1 + np.exp(-score)))
    assert auc(score, y) > 0.9 and {c for c, _ in model.importances()[:2]} == {"a", "b"}
    assert dict(model.importances())["e"] == dict(model.importances())["f"] == 0.0


def test_best_first_takes_no_more_passes_than_levels():
    """Histograms are asked for level by level, and the tree is that of one split after the other."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 16, (3000, 3)).astype(np.uint8)
    y = ((bins[:, 0] > 5) ^ (bins[:, 1] > 9)) * 1.0 + np.sin(bins[:, 2]) + bins[:, 0] * 0.1 + rng.normal(size=3000) * 0.3
    g, h = np.rint((0.5 - y) * boosting.POINT), np.full(3000, boosting.POINT / 4)
    calls = []

    def histograms(tree, nodes):
        calls.append(len(nodes))
        leaf, out = tree.leaves(bins), np.zeros((len(nodes), 3, 16, 3), np.int64)
        for k, node in enumerate(nodes):
            for f in range(3):
                np.add.at(out[k, f], bins[leaf == node, f], np.stack([g, h, np.ones(3000)], 1)[leaf == node].astype(np.int64))
        return out

    rule = boosting.Growth(8, 12, 1.0, 1.0, 5)
    tree = boosting.grow(rule, histograms)
    splits, values = plain_tree(bins, g / boosting.POINT, h / boosting.POINT, 8, 12, 1.0, 1.0, 5)
    got, found = paths(tree)
    assert sorted(got) == sorted(splits) and found == pytest.approx(values, abs=1e-6)
    assert len(calls) <= 8 and len(splits) == 11


def test_degenerate_training_tables(spark):
    none = spark.createDataFrame([], "label int, a double")
    one = spark.createDataFrame([(1, 2.0), (1, None), (None, 5.0)], "label int, a double")
    for df in (none, one):
        model = boosting.BoostedTrees(["a", "absent"], maxIter=2).fit(df)
        assert [r["probability"] for r in model.transform(one).collect()] == [pytest.approx(0.5, abs=0.5)] * 3
        net = networks.Network(["a", "absent"], hidden=[2], kinds=["relu"], maxIter=2, heldOut=0.0).fit(df)
        assert all(0 <= r["probability"] <= 1 for r in net.transform(one).collect())


def test_sums_go_up_a_tree(spark):
    def add(total, batch):
        total += np.array([batch.num_rows, sum(batch.column(0).to_pylist())])

    rows = spark.range(1000, numPartitions=70)
    assert tree_sum(rows, per_task(add, lambda: np.zeros(2, np.int64)), (2,), np.int64, 70).tolist() == [1000, 499500]
    assert tree_sum(rows.where("id < 0"), per_task(add, lambda: np.zeros(2, np.int64)), (2,), np.int64, 70).tolist() == [0, 0]


def test_gradients_are_those_of_the_loss():
    layers = networks.Layers(3, [4, 2], ["relu", "tanh"])
    rng = np.random.default_rng(1)
    flat, x, y = layers.start(3), rng.normal(size=(9, 3)), rng.integers(0, 2, 9).astype(float)
    flat += rng.normal(size=len(flat)) * 0.1
    found = layers.gradient(flat, x, y)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        assert found[k] == pytest.approx((layers.loss(flat + step, x, y) - layers.loss(flat - step, x, y)) / 2e-6, abs=1e-5)
    assert layers.penalised().sum() == 3 * 4 + 4 * 2 + 2


def test_training_equals_one_process(table):
    """The same batches in one array, with Adam written out, give the same held-out losses and weights."""
    df, x, y = table
    net = networks.Network(NAMES, hidden=[6], kinds=["relu"], stepSize=0.02, maxIter=6, stepsPerEpoch=3, patience=50)
    state = net.fit(df).state()
    parts = {}
    for r in net.blocks(df).collect():
        parts.setdefault(r["batch"], []).append((np.frombuffer(bytes(r["x"])).reshape(r["n"], -1), np.frombuffer(bytes(r["y"]))))
    parts = {b: (np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v])) for b, v in parts.items()}
    assert set(parts) == {-1, 0, 1, 2} and 350 < len(parts[-1][1]) < 650
    layers = networks.Layers(len(NAMES), [6], ["relu"])
    flat = layers.start(42)
    m, v, t, losses, kept = 0.0, 0.0, 0, [], []
    for _ in range(6):
        losses.append(layers.loss(flat, *parts[-1]) / len(parts[-1][1]))
        kept.append(flat)
        for b in range(3):
            g = (layers.gradient(flat, *parts[b]) + 1e-4 * layers.penalised() * flat) / len(parts[b][1])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert state["losses"] == pytest.approx(losses) and losses[-1] < losses[0]
    assert state["weights"] == pytest.approx(kept[int(np.argmin(losses))].tolist())


def test_early_stopping_and_going_on(spark, table, tmp_path):
    df = table[0].where("u < 1500")
    given = {"hidden": [4], "kinds": ["tanh"], "stepSize": 0.05, "stepsPerEpoch": 2, "patience": 2, "tolerance": 0.5}
    stopped = networks.Network(NAMES, maxIter=30, **given).fit(df).state()
    assert stopped["epochs"] == 3  # the first loss counts as better, the next two by less than the tolerance
    folder, given["tolerance"] = f"file://{tmp_path}/kept", 1e-4
    whole = networks.Network(NAMES, maxIter=5, **given).fit(df).state()
    networks.Network(NAMES, maxIter=2, checkpoint=folder, **given).fit(df)
    on = networks.Network(NAMES, maxIter=5, checkpoint=folder, **given).fit(df).state()
    assert on["losses"] == pytest.approx(whole["losses"]) and on["weights"] == pytest.approx(whole["weights"])


def test_bundle_of_eleven(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, -k, k % 2, k % 2 + rng.random(), rng.random(), "kept") for k in range(200)]
    df = materialize(spark.createDataFrame(rows, "u int, v int, label int, common_neighbors double, x double, features string"), "bundle")
    columns = ["common_neighbors", "x"]
    zoo = M.zoo(columns)
    for name in ("boosted_trees", "boosted_trees_leafwise"):
        trees = zoo[name].getStages()[0]
        trees.set(trees.maxIter, 4)
    for name in ("perceptron", "two_layer_net"):
        net = zoo[name].getStages()[1]
        net.set(net.maxIter, 4)
    fitted = {n: m.fit(df) for n, m in zoo.items()}
    folder = f"file://{tmp_path}/bundle"
    M.save_bundle(fitted, folder, {"train": df})
    models, tables = M.load_bundle(spark, folder)
    assert list(models) == list(zoo) and len(models) == 11 and tables["train"].count() == 200
    for name, model in models.items():
        assert isinstance(model, PipelineModel)
        out = model.transform(df)
        assert out.columns == [*df.columns, "probability"]
        want = {r["u"]: r["probability"] for r in fitted[name].transform(df).collect()}
        assert {r["u"]: r["probability"] for r in out.collect()} == want
    assert M.importances(models["boosted_trees"]) == M.importances(fitted["boosted_trees"]) and M.columns_of(models["perceptron"]) == columns
    # An unfitted pipeline is saved by the same writers.
    zoo["boosted_trees_leafwise"].write().overwrite().save(f"{folder}/unfitted")
    again = type(zoo["boosted_trees_leafwise"]).load(f"{folder}/unfitted").getStages()[0]
    assert (again.getOrDefault("maxLeaves"), again.getOrDefault("minRows"), again.getOrDefault("columns")) == (31, 20, columns)
    lr = next(s for s in fitted["logistic_regression"].stages if hasattr(s, "coefficients"))
    assert lr.getRegParam() == pytest.approx(1 / 200)
