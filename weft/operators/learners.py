"""pyspark.ml building blocks of pair classifiers: scaling, heuristics, and what a fitted model has in common.

All of them read named feature columns (or the scaled array that ColumnScaler adds), keep a row's other columns
as they came, and add `probability`. What is fitted is kept as JSON in a Param, so that Spark's own writers and
readers of Pipelines save and load it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns between the stages of a pipeline; the last stage drops them.
SCALED, VECTOR, RAW, CLASS, BOTH = "_scaled", "_vector", "_raw", "_class", "_both"


def finite(x: Column) -> Column:
    """x as a double; infinities, NaN and nulls are 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


class HasColumns(Params):
    columns = Param(Params._dummy(), "columns", "features in the order that the model sees; missing ones are 0", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)

    def vector(self, df: DataFrame) -> Column:
        """The features as array<double>, finite."""
        return F.array(*[finite(F.col(c)) if c in df.columns else F.lit(0.0) for c in self.getOrDefault(self.columns)]).cast("array<double>")

    def _put(self, **values: object) -> None:
        self._setDefault(labelCol="label")
        self._set(**{k: v for k, v in values.items() if v is not None})


class Fitted(HasColumns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model: its state is JSON."""

    fitted = Param(Params._dummy(), "fitted", "what was fitted, as JSON", TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, state: object = None) -> None:
        super().__init__()
        self._put(columns=columns, fitted=None if state is None else json.dumps(state))

    def state(self) -> object:
        return json.loads(self.getOrDefault(self.fitted))


class ScalerModel(Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        centre, width = (F.array(*map(F.lit, v)) if v else F.array().cast("array<double>") for v in self.state())
        scaled = F.zip_with(F.zip_with(self.vector(df), centre, lambda x, m: x - m), width, lambda x, s: x / s)
        return df.withColumn(SCALED, scaled)

    def scale(self) -> dict[str, tuple[float, float]]:
        return dict(zip(self.getOrDefault(self.columns), zip(*self.state())))


class ColumnScaler(HasColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the features as one array, less their mean and over their population deviation (1 where that is 0)."""

    def __init__(self, columns: list[str] | None = None) -> None:
        super().__init__()
        self._put(columns=columns)

    def _fit(self, df: DataFrame) -> ScalerModel:
        names = self.getOrDefault(self.columns)
        x = [finite(F.col(c)) if c in df.columns else F.lit(0.0) for c in names]
        row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(x)]).first()
        return ScalerModel(names, [[row[f"m{k}"] or 0.0 for k in range(len(x))], [row[f"s{k}"] or 1.0 for k in range(len(x))]])


class ToVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The scaled array as MLlib's vector."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(VECTOR, array_to_vector(SCALED))


class ToProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """MLlib's probabilities as that of class 1; drops the columns between stages."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", vector_to_array(BOTH)[1]).drop(SCALED, VECTOR, RAW, CLASS, BOTH)


class HeuristicModel(Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        (name,), (low, high) = self.getOrDefault(self.columns), self.state()
        if name not in df.columns:
            return df.withColumn("probability", F.lit(0.0))
        x = (F.col(name) - low) / (high - low + 1e-9)
        return df.withColumn("probability", F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


class HeuristicScore(HasColumns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A feature scaled to [0, 1] by its range in training; 0 for all where the feature is missing."""

    def __init__(self, feature: str | None = None) -> None:
        super().__init__()
        self._put(columns=None if feature is None else [feature])

    def _fit(self, df: DataFrame) -> HeuristicModel:
        (name,) = self.getOrDefault(self.columns)
        low, high = 0.0, 1.0
        if name in df.columns:
            r = df.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
            low = float(r["a"] or 0.0)
            high = float(r["b"] if r["b"] is not None and r["b"] != r["a"] else low + 1)
        return HeuristicModel([name], [low, high])


def scored(df: DataFrame, features: Column, score) -> DataFrame:  # noqa: ANN001
    """df with probability: score takes a matrix of feature rows, a batch at a time."""

    @F.pandas_udf("double")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(score(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    return df.withColumn("probability", each(features))
