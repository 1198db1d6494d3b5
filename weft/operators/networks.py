"""Dense networks for pair classification, trained data-parallel: gradients of a batch are summed over all tasks.

Rows become blocks of one batch each, dealt by a hash of the features, so the batches are the same however rows
are partitioned. A step reads the blocks of its batch, and the tasks' gradients are summed in a tree; the driver
holds the weights only. The number of steps an epoch is a parameter and doesn't grow with the data. With early
stopping a hashed share of the rows is held out, and its loss, which comes along with an epoch's first step,
decides the end; the weights of the best epoch stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.treesum import held, held_sum, per_task, together
from weft.operators.boosting import TASK_ROWS
from weft.operators.learners import SCALED, Fitted, HasColumns, scored
from weft.sources.scratch import materialize, release

HELD_OUT = -1
_SHAPES = {
    "relu": (lambda x: np.maximum(x, 0.0), lambda out: (out > 0).astype(float)),
    "tanh": (np.tanh, lambda out: 1.0 - out * out),
}


class Layers:
    """Weights and biases of a network with one logit, in one flat vector."""

    def __init__(self, width: int, hidden: list[int], kinds: list[str]) -> None:
        self.sizes, self.kinds = [width, *hidden, 1], kinds
        self.ends = np.cumsum([(a + 1) * b for a, b in zip(self.sizes, self.sizes[1:])])

    def start(self, seed: int) -> np.ndarray:
        """Uniform within sqrt(6 / (inputs + outputs)); biases 0."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            w = rng.uniform(-1.0, 1.0, (a + 1, b)) * np.sqrt(6.0 / (a + b))
            w[a] = 0.0
            parts.append(w.ravel())
        return np.concatenate(parts)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        return [w.reshape(a + 1, b) for w, a, b in zip(np.split(flat, self.ends[:-1]), self.sizes, self.sizes[1:])]

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Each layer's output; the last is the logit."""
        out = [x]
        weights = self.split(flat)
        for k, w in enumerate(weights):
            z = out[-1] @ w[:-1] + w[-1]
            out.append(_SHAPES[self.kinds[k]][0](z) if k + 1 < len(weights) else z)
        return out

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        z = self.forward(flat, x)[-1][:, 0]
        return float((np.logaddexp(0.0, z) - y * z).sum())

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the loss summed over rows."""
        out, weights = self.forward(flat, x), self.split(flat)
        back = 1 / (1 + np.exp(-out[-1])) - y[:, None]
        parts = []
        for k in range(len(weights) - 1, -1, -1):
            parts.append(np.concatenate([out[k].T @ back, back.sum(0)[None]]).ravel())
            if k:
                back = (back @ weights[k][:-1].T) * _SHAPES[self.kinds[k - 1]][1](out[k])
        return np.concatenate(parts[::-1])

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for biases."""
        return np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(self.sizes, self.sizes[1:])])


class Optimiser:
    """Adam, or plain gradient descent. Its state is the flat arrays in `kept` and a count of steps."""

    def __init__(self, kind: str, rate: float, size: int) -> None:
        self.kind, self.rate, self.steps = kind, rate, 0
        self.kept = np.zeros((2, size))

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        if self.kind == "sgd":
            return flat - self.rate * gradient
        m, v = self.kept
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        return flat - self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


class NetworkModel(Fitted):
    """State: layers, weights, and each epoch's held-out loss."""

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state()
        layers, flat = Layers(state["width"], state["hidden"], state["kinds"]), np.array(state["weights"])
        x = F.col(SCALED) if SCALED in df.columns else self.vector(df)
        return scored(df, x, lambda rows: 1 / (1 + np.exp(-layers.forward(flat, rows)[-1][:, 0]))).drop(SCALED)


class Network(HasColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A dense network on the scaled features (those of a ColumnScaler before it, else as they are)."""

    hidden = Param(Params._dummy(), "hidden", "sizes of hidden layers", TypeConverters.toListInt)
    kinds = Param(Params._dummy(), "kinds", "relu or tanh, one a hidden layer", TypeConverters.toListString)
    optimiser = Param(Params._dummy(), "optimiser", "adam or sgd", TypeConverters.toString)
    stepSize = Param(Params._dummy(), "stepSize", "rate", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "penalty on weights, over the rows of a batch", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "epochs at most", TypeConverters.toInt)
    stepsPerEpoch = Param(Params._dummy(), "stepsPerEpoch", "batches, whatever the number of rows", TypeConverters.toInt)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows whose loss decides the end; 0: none", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without a better loss that end training", TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "what a better loss is better by", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of first weights and of batches", TypeConverters.toInt)
    checkpoint = Param(Params._dummy(), "checkpoint", "a folder where training is kept epoch by epoch, and from where it goes on", TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, **params: object) -> None:
        super().__init__()
        self._setDefault(hidden=[64, 32], kinds=["relu", "relu"], optimiser="adam", stepSize=0.001, l2=1e-4, maxIter=200, stepsPerEpoch=5, heldOut=0.1, patience=10, tolerance=1e-4, seed=42, checkpoint="")
        self._put(columns=columns, **params)

    def blocks(self, df: DataFrame) -> DataFrame:
        """(batch, x, y, n): rows of one batch; batch HELD_OUT is the held-out share."""
        steps, share = self.getOrDefault(self.stepsPerEpoch), self.getOrDefault(self.heldOut)
        x = F.col(SCALED) if SCALED in df.columns else self.vector(df)
        y = F.col(self.getOrDefault(self.labelCol)).cast("double")
        draw = F.pmod(F.xxhash64(F.lit(self.getOrDefault(self.seed)), "x", "y"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = df.select(x.alias("x"), y.alias("y")).where("y is not null").withColumn("draw", draw)
        place = F.floor((F.col("draw") - share) / (1.0 - share) * steps).cast("int")
        dealt = rows.select("x", "y", F.when(F.col("draw") < share, HELD_OUT).otherwise(F.least(place, F.lit(steps - 1))).alias("batch"))
        schema = pa.schema([("batch", pa.int32()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    of, label = b.column("batch").to_numpy(), b.column("y").to_numpy()
                    found = [(int(k), int((of == k).sum()), m[of == k].tobytes(), label[of == k].tobytes()) for k in np.unique(of)]
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

        return dealt.mapInArrow(pack, "batch int, n bigint, x binary, y binary")

    def _fit(self, df: DataFrame) -> NetworkModel:
        get = lambda p: self.getOrDefault(getattr(self, p))
        names, spark = get("columns"), df.sparkSession
        layers = Layers(len(names), get("hidden"), get("kinds"))
        ready = self.blocks(df)
        rows = df.count()
        blocks = materialize(ready.coalesce(max(1, rows // TASK_ROWS)), "network")
        sizes = {r["batch"]: r["n"] for r in blocks.groupBy("batch").agg(F.sum("n").alias("n")).collect()}
        steps, early = get("stepsPerEpoch"), sizes.get(HELD_OUT, 0) > 0
        kept_rows = {k: held(blocks.where(F.col("batch") == k)) for k in sizes}
        flat = layers.start(get("seed"))
        state = Optimiser(get("optimiser"), get("stepSize"), len(flat))
        best, best_loss, waited, losses, epoch = flat, np.inf, 0, [], 0
        penalty, folder = get("l2") * layers.penalised(), get("checkpoint")
        if folder and (kept := _load(spark, folder)) is not None:
            flat, state.kept, best = kept["arrays"][0], kept["arrays"][1:3].copy(), kept["arrays"][3]
            state.steps, waited, epoch, losses = kept["steps"], kept["waited"], kept["epoch"], list(kept["losses"])
            best_loss = min(losses, default=np.inf)
        while epoch < get("maxIter") and (not early or waited < get("patience")):
            for k in range(steps):
                with_loss = early and k == 0
                if not sizes.get(k) and not with_loss:
                    continue
                read = [kept_rows[b] for b in ([k, HELD_OUT] if with_loss else [k]) if b in kept_rows]
                total = held_sum(together(spark, read), _step(layers, flat), (len(flat) + 1,), np.float64)
                if with_loss:
                    losses.append(float(total[-1]) / sizes[HELD_OUT])
                    better = losses[-1] < best_loss - get("tolerance")
                    waited = 0 if better else waited + 1
                    if losses[-1] < best_loss:
                        best, best_loss = flat.copy(), losses[-1]
                if sizes.get(k):
                    flat = state.step(flat, (total[:-1] + penalty * flat) / sizes[k])
            epoch += 1
            if folder:
                _keep(spark, folder, epoch, np.stack([flat, *state.kept, best]), state.steps, waited, losses)
        for x in kept_rows.values():
            x.unpersist()
        release(spark, blocks)
        final = best if early else flat
        return NetworkModel(names, {"width": len(names), "hidden": get("hidden"), "kinds": get("kinds"), "weights": final.tolist(), "losses": losses, "epochs": epoch})


def _step(layers: Layers, flat: np.ndarray):  # noqa: ANN202
    """The gradient of a batch's rows, and at the end the loss of held-out rows."""

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        for k in range(b.num_rows):
            n = b.column("n")[k].as_py()
            x = np.frombuffer(b.column("x")[k].as_buffer(), np.float64).reshape(n, layers.sizes[0])
            y = np.frombuffer(b.column("y")[k].as_buffer(), np.float64)
            if b.column("batch")[k].as_py() == HELD_OUT:
                total[-1] += layers.loss(flat, x, y)
            else:
                total[:-1] += layers.gradient(flat, x, y)

    return per_task(add, lambda: np.zeros(len(flat) + 1))


def _keep(spark: SparkSession, folder: str, epoch: int, arrays: np.ndarray, steps: int, waited: int, losses: list[float]) -> None:
    row = [(epoch, steps, waited, losses, bytearray(arrays.tobytes()))]
    spark.createDataFrame(row, "epoch int, steps int, waited int, losses array<double>, arrays binary").write.mode("overwrite").parquet(f"{folder}/epoch-{epoch % 2}")


def _load(spark: SparkSession, folder: str) -> dict | None:
    """The later of the last two epochs that were written completely."""
    found = []
    for k in range(2):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch-{k}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found += spark.read.parquet(f"{folder}/epoch-{k}").collect()
    if not found:
        return None
    last = max(found, key=lambda r: r["epoch"]).asDict()
    return last | {"arrays": np.frombuffer(bytes(last["arrays"]), np.float64).reshape(4, -1)}
