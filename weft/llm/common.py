"""Helpers shared by the training-data operators: reading, shared storage, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.sources.scratch import delete, materialize, release, scratch, shared_dir

__all__ = ["delete", "input_partitions", "materialize", "per_batch", "release", "scratch", "shared_dir", "table", "tune"]

#: Rows and bytes of one Arrow batch between the JVM and Python; both bound a worker's memory.
BATCH_ROWS = 4000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows: one batch of long documents must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """Lift a function on batches to what mapInArrow takes; None stands for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def input_partitions(df: DataFrame) -> int:
    """How many tasks to deal a full shuffle of df to: at least as many as the scan has, or the session's setting."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
