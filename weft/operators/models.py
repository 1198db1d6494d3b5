"""Feature preparation, the eleven classifiers over pair features, and bundles of them on disk.

Every classifier is a pyspark.ml Pipeline: fit it on a table with feature columns and a label, and transform adds
`probability`. Spark's own writers save what was fitted.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.boosting import BoostedTrees
from weft.operators.learners import BOTH, CLASS, RAW, VECTOR, ColumnScaler, HasColumns, HeuristicScore, ToProbability, ToVector, finite
from weft.operators.networks import Network

HEURISTICS = ("common_neighbors", "jaccard_coefficient", "adamic_adar", "resource_allocation", "preferential_attachment")


def clean_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities, NaN and nulls become 0."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def fit_scale(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; deviation 0 counts as 1."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(c) - scale[c][0]) / scale[c][1]).alias(c) if c in scale else F.col(c) for c in df.columns])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add features that are missing, as 0: what was fitted decides the columns."""
    return df.select("*", *[F.lit(0.0).alias(c) for c in columns if c not in df.columns])


# ---- the eleven --------------------------------------------------------------------------------------------


class RidgeLogistic(Pipeline):
    """Logistic regression whose L2 penalty follows the rows, as with strength C over a summed loss: 1 / (C n).

    The rows are counted when it is fitted; MLlib's penalty is over the mean loss.
    """

    def _fit(self, df: DataFrame) -> PipelineModel:
        n = max(df.where(F.col("label").isNotNull()).count(), 1)
        *first, lr, last = self.getStages()
        return Pipeline(stages=[*first, lr.copy({lr.regParam: 1.0 / n}), last]).fit(df)


def _mllib(columns: list[str], estimator, kind: type[Pipeline] = Pipeline) -> Pipeline:  # noqa: ANN001
    named = estimator.setFeaturesCol(VECTOR).setProbabilityCol(BOTH).setRawPredictionCol(RAW).setPredictionCol(CLASS)
    return kind(stages=[ColumnScaler(columns), ToVector(), named, ToProbability()])


def two_layer_net(columns: list[str], **params: object) -> Pipeline:
    """32 ReLU and 16 tanh units, plain gradient descent for 50 epochs of eight steps; no graph takes part in it."""
    given = {"hidden": [32, 16], "kinds": ["relu", "tanh"], "optimiser": "sgd", "stepSize": 0.03, "l2": 0.0, "maxIter": 50, "stepsPerEpoch": 8, "heldOut": 0.0}
    return Pipeline(stages=[ColumnScaler(columns), Network(columns, **given | params)])


def zoo(columns: list[str]) -> dict[str, Pipeline]:
    """The eleven models, unfitted."""
    return {f"heuristic_{h}": Pipeline(stages=[HeuristicScore(h)]) for h in HEURISTICS} | {
        "logistic_regression": _mllib(columns, LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=1000), RidgeLogistic),
        "random_forest": _mllib(columns, RandomForestClassifier(numTrees=100, maxDepth=12, seed=42)),
        "boosted_trees": Pipeline(stages=[BoostedTrees(columns, maxIter=100, maxDepth=6, stepSize=0.08, regLambda=1.0, minHessian=1.0)]),
        "boosted_trees_leafwise": Pipeline(stages=[BoostedTrees(columns, maxIter=100, maxDepth=6, maxLeaves=31, stepSize=0.08, regLambda=0.0, minHessian=1e-3, minRows=20)]),
        "perceptron": Pipeline(stages=[ColumnScaler(columns), Network(columns)]),
        "two_layer_net": two_layer_net(columns),
    }


def columns_of(pipeline: Pipeline | PipelineModel) -> list[str]:
    """The features that a model, fitted or not, takes."""
    stages = pipeline.stages if isinstance(pipeline, PipelineModel) else pipeline.getStages()
    return next(list(s.getOrDefault(s.columns)) for s in stages if isinstance(s, HasColumns))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by importance of trees or size of coefficients; none for other models."""
    for s in model.stages:
        if hasattr(s, "importances"):
            return s.importances()
        for name in ("featureImportances", "coefficients"):
            if hasattr(s, name):
                return sorted(zip(columns_of(model), (abs(float(x)) for x in getattr(s, name).toArray())), key=lambda x: (-x[1], x[0]))
    return []


#: Models that are fitted side by side: fits of few rows wait for the start of their many short jobs.
FITS = 4


def score_all(models: dict[str, Pipeline | PipelineModel], train: DataFrame, test: DataFrame) -> DataFrame:
    """Test pairs scored by every model: (model, u, v, label, score). Models that aren't fitted are, on train."""
    fit = inheritable_thread_target(train.sparkSession)(lambda m: m if isinstance(m, PipelineModel) else m.fit(train))
    with ThreadPoolExecutor(FITS) as pool:
        fitted = dict(zip(models, pool.map(fit, models.values())))
    out = None
    for name, model in fitted.items():
        part = model.transform(test).select(F.lit(name).alias("model"), "u", "v", "label", F.col("probability").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- bundles -----------------------------------------------------------------------------------------------


def save_bundle(models: dict[str, PipelineModel], folder: str, tables: dict[str, DataFrame] | None = None) -> None:
    """Fitted models, and tables that belong to them (a training graph, node statistics, embeddings), below a folder.

    The list of contents is written last: a folder without it isn't a bundle. An earlier bundle is replaced.
    """
    spark = SparkSession.getActiveSession()
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{name}")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
    contents = [(k, "model", n) for k, n in enumerate(models)] + [(k, "table", n) for k, n in enumerate(tables or {})]
    spark.createDataFrame(contents, "place int, kind string, name string").coalesce(1).write.mode("overwrite").json(f"{folder}/contents")


def load_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, PipelineModel], dict[str, DataFrame]]:
    """(models, tables) as they were saved, in the same order."""
    rows = sorted(spark.read.schema("place int, kind string, name string").json(f"{folder}/contents").collect())
    models = {r["name"]: PipelineModel.load(f"{folder}/models/{r['name']}") for r in rows if r["kind"] == "model"}
    return models, {r["name"]: spark.read.parquet(f"{folder}/tables/{r['name']}") for r in rows if r["kind"] == "table"}
