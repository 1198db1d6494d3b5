"""Arrays that tasks hand over, added up in a tree of tasks: the driver gets a few arrays at any number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Arrays that one task, and in the end the driver, adds up.
FAN = 8
#: Bytes of held rows that the driver takes itself, where tasks would take longer to start than to add up.
LOCAL_BYTES = 1 << 24
_SCHEMA = pa.schema([("part", pa.binary())])


def one_row(array: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([array.tobytes()], pa.binary())], schema=_SCHEMA)


def per_task(add: Callable[[np.ndarray, pa.RecordBatch], None], empty: Callable[[], np.ndarray]) -> Callable[[Iterator], Iterator]:
    """What mapInArrow takes: add changes a task's array by a batch; a task without rows hands over nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = empty() if total is None else total
                add(total, b)
        if total is not None:
            yield one_row(total)

    return task


def tree_sum(rows: DataFrame, task: Callable[[Iterator], Iterator], shape: tuple[int, ...], dtype: type, tasks: int) -> np.ndarray:
    """The sum of the arrays that `task` yields on rows, which have `tasks` partitions."""

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        for x in b.column("part"):
            total += np.frombuffer(x.as_buffer(), dtype)

    size = int(np.prod(shape))
    parts = rows.mapInArrow(task, "part binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(per_task(add, lambda: np.zeros(size, dtype)), "part binary")
    out = np.zeros(size, dtype)
    for r in parts.collect():
        out += np.frombuffer(r["part"], dtype)
    return out.reshape(shape)


class Local:
    """What `held` gives for few rows: the batches of each partition, in the driver."""

    def __init__(self, parts: list[list[bytes]]) -> None:
        self.parts = parts

    def mapped(self, task: Callable[[Iterator], Iterator]) -> Local:
        return Local([[_blob(b) for b in task(_opened(part)) if b.num_rows] for part in self.parts])

    def unpersist(self) -> None:
        self.parts = []


def _blob(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _opened(blobs: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    return (b for x in blobs for b in pa.ipc.open_stream(x))


def held(rows: DataFrame) -> RDD | Local:
    """rows as Arrow batches that the executors hold, for loops of many short jobs: `held_sum` needs no plan for each.

    Few rows in few partitions come to the driver instead. Sums are the same: of the same parts, in the same order.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array([_blob(b)], pa.binary())], names=["part"])

    kept = rows.mapInArrow(pack, "part binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    if kept.getNumPartitions() > FAN or kept.map(len).sum() > LOCAL_BYTES:
        return kept
    local = Local(kept.glom().collect())
    kept.unpersist()
    return local


def together(spark: SparkSession, several: list[RDD | Local]) -> RDD | Local:
    """The partitions of several tables that are held, one after the other."""
    if all(isinstance(x, Local) for x in several):
        return Local([part for x in several for part in x.parts])
    sc = spark.sparkContext
    return sc.union([sc.parallelize(x.parts, max(len(x.parts), 1)).flatMap(list) if isinstance(x, Local) else x for x in several])


def held_sum(rows: RDD | Local, task: Callable[[Iterator], Iterator], shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """tree_sum of what `held` gave."""

    def part(blobs: Iterable[bytes]) -> Iterator[np.ndarray]:
        for b in task(_opened(blobs)):
            yield from (np.frombuffer(x.as_buffer(), dtype) for x in b.column("part"))

    if isinstance(rows, Local):
        return sum((x for blobs in rows.parts for x in part(blobs)), np.zeros(int(np.prod(shape)), dtype)).reshape(shape)
    tasks, parts = rows.getNumPartitions(), rows.mapPartitions(part)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        keyed = parts.mapPartitionsWithIndex(lambda i, arrays, n=tasks: ((i % n, x) for x in arrays))
        parts = keyed.reduceByKey(lambda a, b: a + b, tasks).values()
    return sum(parts.collect(), np.zeros(int(np.prod(shape)), dtype)).reshape(shape)
