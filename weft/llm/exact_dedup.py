"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal texts side by
side, and full comparisons of neighbours find the runs of equals; one row of each run stays.

The sort key is (leading bytes, SHA-256, full text, id). Leading bytes keep the order a content order and the
splitters small; the id as last column lets a run of equals spread over many tasks, so that a group of copies
that holds a third of all rows is no hot task. A run that crosses task borders is put together again from one
summary row a border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize, tune

#: Leading characters that the splitters compare; longer common beginnings are told apart by the digest.
LEAD = 48

_RUNS = "row_id bigint, digest binary, run_rows bigint, run_min bigint, run_max bigint, head boolean, edge boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content -> rows with the size, least and largest id of their run in this task.

    Memory: the ids of one run and one batch; texts are compared with their neighbour only.
    """
    schema = pa.schema([("row_id", pa.int64()), ("digest", pa.binary()), ("run_rows", pa.int64()), ("run_min", pa.int64()), ("run_max", pa.int64()), ("head", pa.bool_()), ("edge", pa.bool_())])
    ids: list = []
    digest, text, first = b"", None, True

    def flush(edge: bool) -> pa.RecordBatch:
        known = [i for i in ids if i is not None]
        lo, hi, n = min(known, default=None), max(known, default=None), len(ids)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array([n] * n, pa.int64()), pa.array([lo] * n, pa.int64()), pa.array([hi] * n, pa.int64()), pa.array([True] + [False] * (n - 1)), pa.array([edge] * n)], schema=schema)

    pending: list[pa.RecordBatch] = []
    for batch in batches:
        for row_id, d, t in zip(*(batch.column(k).to_pylist() for k in ("row_id", "digest", "norm"))):
            if ids and not (d == digest and t == text):
                pending.append(flush(edge=first))
                first = False
                ids = []
            ids.append(row_id)
            digest, text = d, t
        if pending:
            yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            pending = []
    if ids:
        yield flush(edge=True)


def exact_dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id", normalise: Column | None = None, keep: str = "min") -> DataFrame:
    """Return one row per input row: row_id, keep_id, group_size, kept, text_sha256.

    normalise: the compared form, default the text as it is. keep: 'min' or 'max' row_id of a group stays.
    Null texts count as empty. Rows without id belong to their group, and never stay unless all of the group
    lack one (then keep_id is null and all of them are kept). Repeated rows (same id, same text) are all kept
    if their id is. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    tune(spark)
    norm = F.coalesce(normalise if normalise is not None else F.col(text), F.lit(""))
    keyed = docs.select(F.col(row_id).cast("bigint").alias("row_id"), norm.cast("binary").alias("norm"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("lead", F.substring("norm", 1, LEAD))
    ordered = keyed.repartitionByRange("lead", "digest", "row_id").sortWithinPartitions("lead", "digest", "norm", "row_id")
    runs = materialize(ordered.select("row_id", "digest", "norm").mapInArrow(_runs, _RUNS), "runs")
    # At most two rows a task are edges; only digests that head a run in more than one task need them.
    borders = runs.where("edge and head").groupBy("digest").agg(F.count("*").alias("parts"), F.sum("run_rows").alias("all_rows"), F.min("run_min").alias("all_min"), F.max("run_max").alias("all_max")).where("parts > 1")
    best = "all_" + keep, "run_" + keep
    out = runs.join(F.broadcast(borders), "digest", "left").select(
        "row_id",
        F.when(F.col("parts").isNotNull(), F.col(best[0])).otherwise(F.col(best[1])).alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return out.select(F.col("row_id").alias(row_id), "keep_id", "group_size", F.coalesce(F.col("row_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
