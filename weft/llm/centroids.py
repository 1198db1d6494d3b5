"""Centroid clustering on distinct vectors.

Identical quantised vectors are grouped first, so a vector that a third of all rows share is one row with a
multiplicity; Lloyd rounds run on distinct vectors with weighted integer sums, which tasks hand over as one row
each and Spark adds up. The assignments are then joined back to the rows by vector. Vectors that make up more
than a set share of the rows are joined by broadcast (there can only be so many), all others by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import lloyd
from weft.llm.common import materialize, tune

#: A vector with at least one row in so many is joined by broadcast: at most so many vectors.
HOT = 200


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = lloyd.squared(x, centres)
    a = d.argmin(1)
    return a, d[np.arange(len(x)), a]


def _sums(centres: np.ndarray):  # noqa: ANN202
    """Weighted sums by nearest centre: one row a task, whatever it read."""
    schema = pa.schema([("sums", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), 1 + centres.shape[1]), np.int64)
        for b in batches:
            if b.num_rows:
                x = lloyd.matrix(b.column("x"), centres.shape[1])
                sums += lloyd.sums_of(x, _nearest(x, centres)[0], len(centres), b.column("n").to_numpy())
        yield pa.record_batch([pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], schema=schema)

    return task


def _assign(centres: np.ndarray):  # noqa: ANN202
    schema = pa.schema([("x", pa.list_(pa.int32())), ("n", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, d = _nearest(lloyd.matrix(b.column("x"), centres.shape[1]), centres)
                yield pa.record_batch([b.column("x").cast(pa.list_(pa.int32())), b.column("n"), pa.array(a, pa.int32()), pa.array(d, pa.int64())], schema=schema)

    return task


def digest(centre: np.ndarray) -> str:
    """SHA-256 of the components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", width: int = 64, k: int = 40, rounds: int = 5, scale: float = 256.0, key: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """Return (row_id, cluster, distance, cluster_inertia, inertia) of every kept vector, and the centroids (k, width).

    Components become floor(scale * x). Centroids start as the k kept vectors of smallest key (default: the
    SHA-256 of `2:<id>` in hex), in that order; rows of equal key are ordered by vector, rows with null keys
    (null ids) come last; fewer centroids where fewer vectors are kept. Ties go to the smaller number, empty
    centroids stay. distance: squared, in integers. Inertias past a long are null.

    Left out: null vectors, those of another length than width, those with a null or non-finite component, and
    those longer than 2**30 after scaling. Repeated rows count each. An empty table gives an empty result.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    tune(spark)
    order = key if key is not None else F.sha2(F.concat(F.lit("2:"), F.col(row_id).cast("string")), 256)
    kept = vectors.where(F.size(vector) == width).select(F.col(row_id).cast("bigint").alias("row_id"), order.alias("key"), lloyd.integers(vector, scale).alias("x")).where("x is not null")
    distinct = materialize(kept.groupBy("x").agg(F.count("*").alias("n")), "distinct")
    seeds = kept.orderBy(F.col("key").asc_nulls_last(), "x").limit(k).select("x").collect()
    centres = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), width)
    names = {"row_id": row_id}
    if not len(centres):
        return spark.createDataFrame([], "row_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint").withColumnsRenamed(names), centres
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(centres), "sums array<bigint>")
        centres = lloyd.moved(centres, lloyd.total(sums, "sums", (len(centres), 1 + width)))
    assigned = materialize(distinct.mapInArrow(_assign(centres), "x array<int>, n bigint, cluster int, distance bigint"), "assigned")
    found = {r["cluster"]: (int(r["s"]), r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance")).alias("s"), F.sum("n").alias("n")).collect()}
    everything, rows = sum(s for s, _ in found.values()), sum(n for _, n in found.values())
    fits = lambda v: v if v < 1 << 63 else None
    inertias = spark.createDataFrame([(c, fits(s), fits(everything)) for c, (s, _) in found.items()], "cluster int, cluster_inertia bigint, inertia bigint")
    least = -(-rows // HOT)
    places = kept.select("row_id", "x")
    hot, cold = assigned.where(F.col("n") >= least).drop("n"), assigned.where(F.col("n") < least).drop("n")
    if hot.isEmpty():
        joined = places.join(cold, "x")
    else:
        joined = places.join(F.broadcast(hot), "x").unionByName(places.join(F.broadcast(hot), "x", "left_anti").join(cold, "x"))
    out = joined.join(F.broadcast(inertias), "cluster")  # one row a centroid
    return out.select(F.col("row_id").alias(row_id), "cluster", "distance", "cluster_inertia", "inertia"), centres


def hashes(clustered: DataFrame, centres: np.ndarray) -> DataFrame:
    """clustered with centroid_sha256."""
    named = clustered.sparkSession.createDataFrame([(k, digest(c)) for k, c in enumerate(centres)], "cluster int, centroid_sha256 string")
    return clustered.join(F.broadcast(named), "cluster", "left")  # one row a centroid
