"""Gradient-boosted trees on histograms: second-order gains, level by level or best leaf first.

Features become bins cut at approximate quantiles; rows become blocks of bins, labels and scores in a shared
table. For a set of nodes, every task adds the gradients of its rows up by node, feature and bin, and the tasks'
histograms are summed in a tree. Gradients are integers of fixed point, so sums don't depend on how rows are
dealt. Of two siblings only the one with fewer rows is counted; the other is its parent less that one.

A node's best split doesn't depend on when it is split. Best-first growth therefore asks for the histograms of
all nodes that it would split as far as gains are known, a level at a time, and repeats until every gain that
decides is known: the tree is that of splitting one leaf after the other, in a few passes instead of one a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.treesum import Local, held, held_sum, per_task
from weft.operators.learners import Fitted, HasColumns, scored
from weft.sources.scratch import materialize, release

#: Gradients in units of 2**-30: a sum over 2**33 rows fits a long.
POINT = float(1 << 30)
#: Trees after which the blocks are written again with their scores; tasks add the trees since.
REWRITE = 8
#: Rows that make a task worth its start; fewer rows go to fewer tasks.
TASK_ROWS = 1 << 16


@dataclass
class Tree:
    """Nodes in order of creation; a leaf has feature -1. Rows of a bin up to `bin` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(v)
            self.gain.append(0.0)
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[node] >= 0).any():
            low = bins[rows, np.maximum(feature[node], 0)] <= at[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the columns of x: the number of cuts below a value."""
    return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)


@dataclass
class Growth:
    """How trees grow."""

    depth: int
    leaves: int  # 0: all that depth allows, level by level
    l2: float
    least_hessian: float
    least_rows: int
    least_gain: float = 0.0

    def gain(self, g, h):  # noqa: ANN001, ANN201
        return g * g / (h + self.l2 + 1e-16)

    def value(self, g: float, h: float) -> float:
        return -g / (h + self.l2 + 1e-16)

    def best(self, hist: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, feature, bin) of a node's best split, of equal ones that of the least feature and bin; hist: (features, bins, 3)."""
        left = np.cumsum(hist, axis=1)
        total = left[:1, -1:]
        right = total - left
        g, h, n = (left[..., k] for k in range(3))
        gr, hr, nr = (right[..., k] for k in range(3))
        gains = self.gain(g / POINT, h / POINT) + self.gain(gr / POINT, hr / POINT) - self.gain(total[..., 0] / POINT, total[..., 1] / POINT)
        allowed = (np.minimum(n, nr) >= max(self.least_rows, 1)) & (np.minimum(h, hr) >= self.least_hessian * POINT)
        gains = np.where(allowed, gains / 2, -np.inf)
        at = int(gains.argmax())
        f, b = divmod(at, gains.shape[1])
        return (float(gains[f, b]), f, b) if gains[f, b] > self.least_gain + 1e-12 else None


def grow(rule: Growth, histograms) -> Tree:  # noqa: ANN001
    """A tree. histograms(tree, nodes) -> (nodes, features, bins, 3): gradients, hessians and rows of those nodes.

    `full` is the tree of all splits that were looked at; those that growth takes are copied from it.
    """
    full = Tree()
    root = histograms(full, [0])[0]
    total = root[0].sum(0) / POINT
    full.value[0] = rule.value(total[0], total[1])
    level, hist, best = {0: 0}, {0: root}, {0: rule.best(root) if rule.depth > 0 else None}

    def look(nodes: list[int]) -> None:
        """Split nodes in full, and find their children's best splits."""
        ask = []
        for node in nodes:
            gain, f, b = best[node]
            low, whole = hist[node][f, : b + 1].sum(0), hist[node][f].sum(0)
            high = whole - low
            children = full.split(node, f, b, gain, tuple(rule.value(x[0] / POINT, x[1] / POINT) for x in (low, high)))
            for child in children:
                level[child], best[child] = level[node] + 1, None
            if level[node] + 1 < rule.depth:
                ask.append((node, children, low[2] <= high[2]))
            else:
                hist.pop(node)
        if ask:
            counted = histograms(full, [c[0] if first else c[1] for _, c, first in ask])
            for (node, (a, b), first), x in zip(ask, counted):
                rest = hist.pop(node) - x
                hist[a], hist[b] = (x, rest) if first else (rest, x)
                best[a], best[b] = rule.best(hist[a]), rule.best(hist[b])

    if not rule.leaves:
        while nodes := [n for n in best if best[n] is not None and full.feature[n] < 0]:
            look(nodes)
        return full
    while True:
        order, unknown = chosen(full, best, rule.leaves)
        if not unknown:
            break
        look(unknown)
    tree, place = Tree(value=full.value[:1]), {0: 0}
    for node in order:
        a, b = full.left[node], full.right[node]
        place[a], place[b] = tree.split(place[node], full.feature[node], full.bin[node], full.gain[node], (full.value[a], full.value[b]))
    return tree


def chosen(full: Tree, best: dict, leaves: int) -> tuple[list[int], list[int]]:
    """Nodes that best-first growth splits, in order, and those of them that haven't been split in full.

    Children that aren't known compete with nothing, so what is split here may change once they are; growth
    ends when nothing chosen is unknown. Of equal gains the node that was created first is split.
    """
    import heapq

    heap = [(-best[0][0], 0)] if best[0] else []
    order, unknown = [], []
    while heap and len(order) < leaves - 1:
        _, node = heapq.heappop(heap)
        order.append(node)
        if full.feature[node] < 0:
            unknown.append(node)
            continue
        for child in (full.left[node], full.right[node]):
            if best[child]:
                heapq.heappush(heap, (-best[child][0], child))
    return order, unknown


def _read(b: pa.RecordBatch, k: int, width: int, pending: list[Tree], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and scores of a block, the scores with what the pending trees add."""
    bins = np.frombuffer(b.column("bins")[k].as_buffer(), np.uint8).reshape(-1, width)
    score = np.frombuffer(b.column("score")[k].as_buffer(), np.float64)
    for t in pending:
        score = score + rate * t.scores(bins)
    return bins, np.frombuffer(b.column("label")[k].as_buffer(), np.uint8), score


def _histogram_task(width: int, most: int, pending: list[Tree], rate: float, tree: Tree, nodes: list[int]):  # noqa: ANN202
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        hist = total.reshape(len(nodes), width, most, 3)
        for k in range(b.num_rows):
            bins, y, score = _read(b, k, width, pending, rate)
            at = slot[tree.leaves(bins)]
            mine = np.flatnonzero(at >= 0)
            p = 1 / (1 + np.exp(-score[mine]))
            g, h = np.rint((p - y[mine]) * POINT), np.rint(p * (1 - p) * POINT)
            for f in range(width):
                key = at[mine] * most + bins[mine, f]
                for c, weight in enumerate((g, h, None)):
                    hist[:, f, :, c] += np.bincount(key, weight, len(nodes) * most).astype(np.int64).reshape(len(nodes), most)

    return per_task(add, lambda: np.zeros(len(nodes) * width * most * 3, np.int64))


_BLOCK = pa.schema([("bins", pa.binary()), ("label", pa.binary()), ("score", pa.binary())])
_BLOCK_DDL = "bins binary, label binary, score binary"


def _block(bins: np.ndarray, label: bytes, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x], pa.binary()) for x in (bins.tobytes(), label, score.tobytes())], schema=_BLOCK)


class BoostedTreesModel(Fitted):
    """State: cuts of the features, the first score, the rate, and the trees."""

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state()
        cuts, trees = [np.array(c) for c in state["cuts"]], [Tree(**t) for t in state["trees"]]

        def score(x: np.ndarray) -> np.ndarray:
            bins = binned(x, cuts)
            return 1 / (1 + np.exp(-(state["first"] + state["rate"] * sum((t.scores(bins) for t in trees), np.zeros(len(x))))))

        return scored(df, self.vector(df), score)

    def trees(self) -> list[Tree]:
        return [Tree(**t) for t in self.state()["trees"]]

    def importances(self) -> list[tuple[str, float]]:
        """Features by their splits' share of the gain."""
        names = self.getOrDefault(self.columns)
        gain = dict.fromkeys(names, 0.0)
        for t in self.trees():
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[names[f]] += g
        whole = sum(gain.values()) or 1.0
        return sorted(((c, g / whole) for c, g in gain.items()), key=lambda x: (-x[1], x[0]))


class BoostedTrees(HasColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosting of logistic loss. maxLeaves 0 grows level by level to maxDepth; else the best leaf first."""

    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "splits above a leaf", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree; 0: no limit but the depth", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 on leaf values", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least sum of second derivatives in a child", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows in a child", TypeConverters.toInt)

    def __init__(self, columns: list[str] | None = None, **params: float) -> None:
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=6, maxLeaves=0, maxBins=256, stepSize=0.08, regLambda=1.0, minHessian=1.0, minRows=1)
        self._put(columns=columns, **params)

    def _cuts(self, df: DataFrame, names: list[str]) -> list[np.ndarray]:
        """Cuts between bins: the values themselves where there are few, else approximate quantiles."""
        bins = min(self.getOrDefault(self.maxBins), 256)
        wide = df.select(*[self.vector(df)[k].alias(f"f{k}") for k in range(len(names))])
        found = wide.approxQuantile(wide.columns, [k / bins for k in range(1, bins)], 0.25 / bins) if names else []
        return [np.unique(np.array(q, float)) for q in found]

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        names, rate = self.getOrDefault(self.columns), self.getOrDefault(self.stepSize)
        rule = Growth(self.getOrDefault(self.maxDepth), self.getOrDefault(self.maxLeaves), self.getOrDefault(self.regLambda), self.getOrDefault(self.minHessian), self.getOrDefault(self.minRows))
        spark, width = df.sparkSession, len(names)
        cuts = self._cuts(df, names)
        most = max((len(c) for c in cuts), default=0) + 1
        label = F.col(self.getOrDefault(self.labelCol)).cast("int")
        share, rows = df.agg(F.avg(label), F.count(label)).first()
        first = 0.0 if share in (None, 0.0, 1.0) else float(np.log(share / (1 - share)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
                    yield _block(binned(x, cuts), b.column("y").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), np.full(b.num_rows, first))

        ready = df.select(self.vector(df).alias("x"), label.alias("y")).where("y is not null").mapInArrow(pack, _BLOCK_DDL)
        blocks = materialize(ready.coalesce(max(1, rows // TASK_ROWS)), "boosting")
        kept, trees, pending = held(blocks), [], []
        for _ in range(self.getOrDefault(self.maxIter)):

            def histograms(tree: Tree, nodes: list[int], kept: RDD | Local = kept, pending: list[Tree] = pending) -> np.ndarray:
                return held_sum(kept, _histogram_task(width, most, pending, rate, tree, nodes), (len(nodes), width, most, 3), np.int64)

            if not width:
                break
            tree = grow(rule, histograms)
            trees.append(tree)
            pending = [*pending, tree]
            if len(pending) == REWRITE and len(trees) < self.getOrDefault(self.maxIter):
                if isinstance(kept, Local):
                    kept, pending = kept.mapped(_rewrite(width, pending, rate)), []
                    continue
                before, blocks = blocks, materialize(blocks.mapInArrow(_rewrite(width, pending, rate), _BLOCK_DDL), "boosting")
                kept.unpersist()
                release(spark, before)
                kept, pending = held(blocks), []
        kept.unpersist()
        return BoostedTreesModel(names, {"cuts": [c.tolist() for c in cuts], "first": first, "rate": rate, "trees": [vars(t) for t in trees]})


def _rewrite(width: int, pending: list[Tree], rate: float):  # noqa: ANN202
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                bins, y, score = _read(b, k, width, pending, rate)
                yield _block(bins, y.tobytes(), score)

    return task
