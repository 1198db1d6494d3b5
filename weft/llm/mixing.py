"""Mixing sources to target weights, cut at exact token budgets.

Rows get hash-random keys and are range-sorted within each source; token counts are summed in two steps
(within tasks, then over one row per task and source), which gives every row the tokens before it in its
source without any source passing through one task. A source's budget is then whole epochs plus a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import materialize, tune

#: A word is a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source with its target: weight-proportional, at most `most` times its size, the rest reshared.

    sizes: (src, source_size), one row per source; src may be null and then comes last in code point order.
    Resharing until nobody is above its cap ends where the sources in order of cap/weight are capped up to
    some rank and all others take the same amount a unit of weight; that rank is found by running sums.
    """
    order = W.orderBy(F.col("src").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("src", "source_size", cases.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("src").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = ranked.select(
        "*",
        ((F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
        F.row_number().over(by_ratio).alias("rank"),
    )
    # The level only rises while sources below it are capped: the first source whose cap is not below it sets it.
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(everything)["level"]
    return levels.select("src", "source_size", F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap")).alias("target"))


_SCHEMA = pa.schema([("row_id", pa.int64()), ("src", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("before", pa.int64())])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row among the rows of its source in this task; keeps one total."""
    total, last = 0, object()
    for batch in batches:
        if not batch.num_rows:
            continue
        src = np.array(batch.column("src").to_pylist(), dtype=object)
        size = batch.column("size").to_numpy()
        change = np.r_[src[0] != last, src[1:] != src[:-1]]
        base = np.cumsum(size) - size
        run = np.cumsum(change) - 1  # -1: goes on from the batch before
        at_start = np.r_[base[change], -total]  # index -1 is the last one
        before = base - at_start[run]
        total, last = int(before[-1] + size[-1]), src[-1]
        yield pa.record_batch([batch.column("row_id"), batch.column("src"), batch.column("size"), batch.column("part"), pa.array(before, pa.int64())], schema=_SCHEMA)


def mix(docs: DataFrame, row_id: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", key: Column | None = None) -> DataFrame:
    """Return one row per input row: row_id, source, size, source_size, target, taken, epochs.

    size: the row's tokens, default the words of its text. Sources take the weights in turn in code point
    order, null last. The mix holds `share` times all tokens. taken: the row's tokens in the mix, repeats
    counted, so each source's taken tokens are its target rounded down; the row at the cut is taken in part.
    epochs: times the row occurs in the mix, a part counting as one. Null texts have size 0 and take nothing. The key is an MD5 of seed and id,
    so reruns agree; rows of equal id are ordered by size. A null id counts as an empty string. Another key, a
    string, can take its place. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(source).alias("src"), (size if size is not None else word_count("text")).alias("size"), (key if key is not None else F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))).alias("key"))
    ordered = rows.repartitionByRange(F.col("src").asc_nulls_last(), "key", "row_id", "size").sortWithinPartitions(F.col("src").asc_nulls_last(), "key", "row_id", "size")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = "row_id bigint, src string, size bigint, part int, before bigint"
    sorted_rows = materialize(ordered.drop("key").mapInArrow(_running, schema), "mix")
    parts = sorted_rows.groupBy("part", "src").agg(F.sum("size").alias("part_size"))
    parts = parts.select("part", "src", F.coalesce(F.sum("part_size").over(W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    sizes = sorted_rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    # As many rows as the sort has tasks, plus the sources; the optimiser broadcasts it only if it is small.
    small = parts.alias("p").join(targets.alias("t"), F.col("p.src").eqNullSafe(F.col("t.src"))).select("part", F.col("p.src").alias("s"), "earlier", "source_size", "target")
    joined = sorted_rows.join(small, (sorted_rows["part"] == small["part"]) & sorted_rows["src"].eqNullSafe(small["s"]))
    budget = F.floor("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.least(rest - (F.col("earlier") + F.col("before")), F.col("size")), F.lit(0).cast("bigint"))
    return joined.select(F.col("row_id").alias(row_id), F.col("src").alias(source), "size", "source_size", "target", (whole * F.col("size") + part).cast("bigint").alias("taken"), F.when(F.col("size") > 0, whole + (part > 0).cast("bigint")).otherwise(0).cast("bigint").alias("epochs"))
