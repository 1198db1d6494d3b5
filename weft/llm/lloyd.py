"""Integer vectors and exact distances for the clustering operators, and sums that tasks hand over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest integer vector that is kept: squared distances between two such vectors fit a long.
LONGEST = 1 << 30


def integers(vector: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as array<int>; null for a vector that can't be kept.

    Not kept: a null vector, one with a null or non-finite component, and one longer than LONGEST after
    scaling (squared distances wouldn't fit a long).
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    scaled = lambda x: F.floor(x.cast("double") * F.lit(scale))
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double") * F.lit(scale)) < float(LONGEST), F.lit(False)))
    whole = F.when(fits, F.transform(v, lambda x: scaled(x).cast("int")))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(square <= float(LONGEST) ** 2, whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's lists of `width` numbers each as rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of x and of c, as int64.

    Components below 2**22 / sqrt(width) make every intermediate an integer that a double holds, so a matrix
    product is exact; others are summed as integers.
    """
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - c[None, :, k]) ** 2
    return out


def sums_of(x: np.ndarray, member: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(k, 1 + width) int64: rows (their weights) and the sum of x by member."""
    full = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
    if weight is not None:
        full = full * weight[:, None]
    out = np.zeros((k, full.shape[1]), np.int64)
    order = np.argsort(member, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(member[order]) != 0]) if len(x) else np.zeros(0, int)
    if len(heads):
        out[member[order][heads]] = np.add.reduceat(full[order], heads)
    return out


def total(parts: DataFrame, column: str, shape: tuple[int, ...]) -> np.ndarray:
    """The tasks' arrays in column added up by Spark; only one number a place reaches the driver."""
    rows = parts.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "value"))
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


def moved(old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centres at floor(sum / count) of their members; centres without members stay. sums: (..., 1 + width)."""
    n = sums[..., :1]
    return np.where(n > 0, np.floor_divide(sums[..., 1:], np.maximum(n, 1)), old)
