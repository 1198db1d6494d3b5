"""Singular and eigenvectors of sparse matrices by block iteration: a block of vectors is a table (id, y).

A multiplication is a join of entries and block on the column and a grouped sum a row, which pre-aggregates.
Blocks are made orthonormal by tall-skinny QR: each task factors its rows, the small triangles are stacked and
factored again in a tree, and rows are multiplied by the inverse. No row is longer than the block is wide, and
the driver holds matrices of the block's width only: blocks are never broadcast, which would send each round's
through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.treesum import FAN

Save = Callable[[DataFrame], DataFrame]
#: Vectors beyond those that are wanted.
SPARE = 8


def start(ids: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, y): hashed numbers in [-1, 1), the same in any partitioning."""
    return ids.select("id", F.array(*[F.xxhash64(F.lit(seed), F.lit(j), "id") / float(1 << 63) for j in range(k)]).alias("y"))


def multiply(entries: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(id, y): the matrix entries(a, b, value) times the block; rows without entries are left out."""
    joined = entries.join(block.select(F.col("id").alias("b"), "y").hint("merge"), "b")
    sums = joined.groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("value") * F.col("y")[j]).alias(f"y{j}") for j in range(k)])
    return sums.select("id", F.array(*[f"y{j}" for j in range(k)]).alias("y"))


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def triangle(block: DataFrame, k: int) -> np.ndarray:
    """R of the block's QR, up to signs."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for b in batches:
            if b.num_rows:
                rows = _rows(b) if "y" in b.schema.names else np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, k) for x in b.column("r")])
                r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["r"])

    tasks, parts = block.rdd.getNumPartitions(), block.select("y").mapInArrow(factor, "r binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(factor, "r binary")
    found = [np.frombuffer(bytes(x["r"])).reshape(-1, k) for x in parts.collect()]
    r = np.linalg.qr(np.concatenate([np.zeros((k, k)), *found]), mode="r")
    return r


def times(block: DataFrame, small: np.ndarray) -> DataFrame:
    """The block's rows times a small matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = _rows(b) @ small
                yield pa.record_batch([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), small.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "y"])

    return block.select("id", "y").mapInArrow(task, "id bigint, y array<double>")


def orthonormal(block: DataFrame, k: int, save: Save | None = None) -> tuple[DataFrame, int, np.ndarray]:
    """(a saved block with orthonormal columns of the same span, their number, singular values of the block).

    With save it is done twice: one factor is as inexact as the block is ill-conditioned, which does between rounds.
    """
    _, s, vt = np.linalg.svd(triangle(block, k))
    keep = s > 1e-10 * max(s[0], 1e-300)
    n, once = int(keep.sum()), times(block, vt.T[:, keep] / s[keep])
    if save is None:
        return once, n, s
    once = save(once)
    return save(times(once, np.linalg.inv(triangle(once, n)))), n, s


def singular(entries: DataFrame, want: int, save: Save, rounds: int = 8, tolerance: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """(id, y) of the `want` leading left singular vectors of entries(a, b, value), and the singular values, descending.

    Rounds end when the values change by less than tolerance of the largest. Fewer vectors where the rank is lower.
    """
    turned = entries.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")
    k = want + SPARE
    block, n, before = save(multiply(entries, start(turned.select(F.col("a").alias("id")).distinct(), k), k)), k, None
    for _ in range(rounds):
        q, n, _ = orthonormal(block, n)
        other, m, s = orthonormal(save(multiply(turned, q, n)), n)
        block, n = save(multiply(entries, other, m)), m
        if before is not None and len(before) == len(s) and (np.abs(s - before)[:want] <= tolerance * s[0]).all():
            break
        before = s
    q, n, _ = orthonormal(block, n, save)
    u, s, _ = np.linalg.svd(triangle(save(multiply(turned, q, n)), n).T)
    want = min(want, int((s > 1e-10 * max(s[0], 1e-300)).sum()))
    return save(times(q, u[:, :want])), s[:want]


def leading_eigen(entries: DataFrame, want: int, top: float, save: Save, degree: int = 6, rounds: int = 12, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray, float]:
    """(id, y) of the `want` largest eigenvectors of a symmetric matrix with eigenvalues in [0, top], the eigenvalues,
    and the largest residual |A y - value y|.

    A block is filtered by a Chebyshev polynomial that is small below the block's least eigenvalue and grows
    fast above it, then made orthonormal and turned to the eigenvectors of the small matrix; rounds end when
    residuals fall below tolerance * top.
    """
    ids = entries.select(F.col("a").alias("id")).distinct()
    k = want + SPARE
    block, n, low = save(start(ids, k)), k, top / 2
    while True:
        rounds -= 1
        scaled = entries.select("a", "b", (F.col("value") * (2.0 / low)).alias("value"))
        last, now = block, save(_less(multiply(scaled, block, n), block, n, 1.0))
        for _ in range(degree - 1):
            # 2 (A' now - now) - last, with A' the matrix whose part below `low` lies in [0, 2].
            doubled = scaled.select("a", "b", (F.col("value") * 2.0).alias("value"))
            last, now = now, save(_less(_less(multiply(doubled, now, n), now, n, 2.0), last, n, 1.0))
        q, n, _ = orthonormal(now, n, save)
        image = save(multiply(entries, q, n))
        small = _inner(q, image, n)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        block = save(times(q, turn))
        rest = _less(times(image, turn), times(block, np.diag(values)), n, 1.0)
        residual = float(np.sqrt(rest.agg(*[F.sum(F.col("y")[j] * F.col("y")[j]) for j in range(min(want, n))]).first()).max())
        low = float(np.clip(values[-1], 1e-3 * top, 0.999 * top))
        if residual <= tolerance * top or rounds <= 0:
            return save(times(block, np.eye(n)[:, : min(want, n)])), values[:want], residual


def _less(a: DataFrame, b: DataFrame, k: int, factor: float) -> DataFrame:
    """a - factor * b; rows that one lacks are zeros."""
    zeros = F.array_repeat(F.lit(0.0), k)
    joined = a.join(b.withColumnRenamed("y", "z").hint("merge"), "id", "full")
    return joined.select("id", F.zip_with(F.coalesce("y", zeros), F.coalesce("z", zeros), lambda x, z: x - factor * z).alias("y"))


def _inner(a: DataFrame, b: DataFrame, k: int) -> np.ndarray:
    """The k * k inner products of two blocks' columns."""
    joined = a.join(b.withColumnRenamed("y", "z").hint("merge"), "id")
    flat = joined.agg(*[F.sum(F.col("y")[i] * F.col("z")[j]) for i in range(k) for j in range(k)]).first()
    return np.array(flat, float).reshape(k, k)
