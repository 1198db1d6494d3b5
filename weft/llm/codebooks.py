"""Vector code compression: a codebook for each part of the vectors, trained by Yinyang Lloyd rounds.

A vector is cut into equal parts, and each part becomes the number of its nearest codebook entry. Entries of a
codebook are clustered into groups; with every part a task keeps its entry and, for each group, a lower bound
of the distance to the group's other entries. After the entries moved, a bound sinks by the group's largest
drift, and only groups whose bound isn't above the distance to the part's own entry are scanned. Bounds are
rounded down and compared with "not above", so a tie is always scanned and settled by exact integer distances,
then by the smaller index.

Rounds read and write one table in the shared folder: vectors, entries and bounds, and with them each task's
sums, so a lost executor repeats its tasks only and counts nothing twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import lloyd
from weft.llm.common import materialize, release, tune

#: Entries of a codebook to one group of bounds.
GROUP = 10
#: Steps of a stored bound over a codebook's widest distance; a bound above all steps is stored as the last.
_STEPS, _LAST = 128, 255
_FAR = np.iinfo(np.int64).max


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: farthest-first centres, then five rounds of Lloyd."""
    at = [0]
    while len(at) < groups:
        near = lloyd.squared(book, book[at]).min(1)
        at.append(int(near.argmax()))
    centres = book[at].astype(float)
    for _ in range(5):
        of = ((book[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([book[of == g].mean(0) if (of == g).any() else centres[g] for g in range(groups)])
    return of


class Round:
    """What the tasks of one round need: entries, their groups, how far groups drifted, and the bounds' steps."""

    def __init__(self, books: np.ndarray, groups: list[np.ndarray], before: np.ndarray | None, step_before: np.ndarray | None) -> None:
        self.books, self.groups = books, groups
        self.count = max(int(g.max()) for g in groups) + 1
        self.step_before = step_before
        spread = np.array([np.sqrt(lloyd.squared(b, b).max()) for b in books])
        self.step = np.maximum(spread, 1.0) / _STEPS
        self.drift = np.zeros((len(books), self.count))
        if before is not None:
            far = np.sqrt(((books - before) ** 2).sum(2)) * (1 + 1e-9)
            for p, of in enumerate(groups):
                np.maximum.at(self.drift[p], of, far[p])

    def first(self, p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, squared distance and bounds of every row by a scan of all entries."""
        d = lloyd.squared(x, self.books[p])
        rows = np.arange(len(x))
        a = d.argmin(1)
        best = d[rows, a]
        d[rows, a] = _FAR
        low = np.full((len(x), self.count), float(_FAR))
        for g in range(self.count):
            members = np.flatnonzero(self.groups[p] == g)
            if len(members):
                low[:, g] = d[:, members].min(1)
        return a, best, np.sqrt(low)

    def next(self, p: int, x: np.ndarray, a: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the round before's entries and stored bounds; the last value counts scanned distances."""
        book, of = self.books[p], self.groups[p]
        low = stored * self.step_before[p] - self.drift[p]
        old, a = a, a.copy()
        own = ((x - book[a]) ** 2).sum(1)
        best, scanned = own.copy(), len(x)
        scan = low <= (np.sqrt(own.astype(float)) * (1 + 1e-9))[:, None]
        seen = []
        for g in range(self.count):
            members, rows = np.flatnonzero(of == g), np.flatnonzero(scan[:, g])
            if not len(rows) or not len(members):
                continue
            d = lloyd.squared(x[rows], book[members])
            scanned += d.size
            at = np.arange(len(rows))
            j = d.argmin(1)
            nearest, entry = d[at, j], members[j]
            d[at, j] = _FAR
            seen.append((g, rows, entry, nearest, d.min(1)))
            better = (nearest < best[rows]) | ((nearest == best[rows]) & (entry < a[rows]))
            best[rows[better]], a[rows[better]] = nearest[better], entry[better]
        # An entry that was left counts among its group's others again.
        left = np.flatnonzero(a != old)
        low[left, of[old[left]]] = np.minimum(low[left, of[old[left]]], np.sqrt(own[left].astype(float)))
        for g, rows, entry, nearest, second in seen:
            low[rows, g] = np.sqrt(np.where(entry == a[rows], second, nearest).astype(float))
        return a, best, low, scanned

    def stored(self, p: int, low: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(low * (1 - 1e-9) / self.step[p]), 0, _LAST).astype(np.uint8)


def _pass(turn: Round, width: int, label: pa.DataType, last: bool):  # noqa: ANN202
    """A task of one round: rows with entries and bounds (or, in the last, errors), then one row of sums."""
    parts, entries, _ = turn.books.shape
    each = width // parts
    schema = pa.schema([("row_id", pa.int64()), ("label", label)] + ([("code", pa.binary()), ("error", pa.int64())] if last else [("x", pa.list_(pa.int32())), ("code", pa.binary()), ("bounds", pa.binary()), ("sums", pa.list_(pa.int64()))]) + [("scanned", pa.int64())])

    def blob(m: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in m], pa.binary())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned = np.zeros((parts, entries, 1 + each), np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = lloyd.matrix(b.column("x"), width)
            codes, low = np.zeros((n, parts), np.uint8), np.zeros((n, parts, turn.count), np.uint8)
            error = np.zeros(n, np.int64)
            known = "code" in b.schema.names
            if known:
                was = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
                bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), np.uint8).reshape(n, parts, turn.count)
            for p in range(parts):
                piece = x[:, p * each : (p + 1) * each]
                if known:
                    a, best, far, work = turn.next(p, piece, was[:, p].astype(np.int64), bounds[:, p].astype(float))
                else:
                    a, best, far = turn.first(p, piece)
                    work = n * entries
                scanned += work
                codes[:, p] = a
                error += best
                if not last:
                    low[:, p] = turn.stored(p, far)
                    sums[p] += lloyd.sums_of(piece, a, entries)
            shared = [b.column("row_id"), b.column("label")]
            if last:
                yield pa.record_batch([*shared, blob(codes), pa.array(error), pa.nulls(n, pa.int64())], schema=schema)
            else:
                yield pa.record_batch([*shared, b.column("x").cast(pa.list_(pa.int32())), blob(codes), blob(low), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], schema=schema)
        tail = {"sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), "scanned": pa.array([scanned], pa.int64())}
        yield pa.record_batch([tail.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

    return task


def compress(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, np.ndarray]:
    """Return (row_id, label, code, error) of every kept vector, and the codebooks (parts, entries, width of a part).

    code: binary, the index of each part's entry; error: the squared distance to the entries, in integers
    floor(scale * x). Codebooks start as the parts of the `entries` rows of smallest id (ids that repeat are
    ordered by vector, null ids come last), fewer where fewer rows are kept. Ties go to the lower index; an
    entry that nothing is assigned to stays.

    Left out: null vectors, those with a null or non-finite component, those longer than 2**30 after scaling,
    and those of another length than the kept row of smallest id whose length is a positive multiple of parts.
    Repeated rows are encoded each. An empty table gives an empty result and no entries. Other columns aren't read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: entries from 1 to 256")
    spark = vectors.sparkSession
    tune(spark)
    named = vectors.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(label).alias("label"), lloyd.integers(vector, scale).alias("x"))
    ready = named.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0))
    order = F.struct(F.col("row_id").isNull(), F.col("row_id"), F.col("x"))
    width = ready.agg(F.min_by(F.size("x"), order)).first()[0]
    kind = T.StructType([T.StructField("label", named.schema["label"].dataType)])
    empty = spark.createDataFrame([], T.StructType([T.StructField("row_id", T.LongType()), *kind.fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))
    if width is None:
        return empty.withColumnsRenamed({"row_id": row_id, "label": label}), np.zeros((parts, 0, 0), np.int64)
    state = ready.where(F.size("x") == width)
    seeds = state.orderBy(F.col("row_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    groups = [grouped(b, max(1, -(-len(seeds) // GROUP))) for b in books]
    ddl = f"row_id bigint, label {named.schema['label'].dataType.simpleString()}, "
    arrow = _arrow(kind)
    before = step = None
    for turn in range(rounds + 1):
        now, last = Round(books, groups, before, step), turn == rounds
        out = ddl + ("code binary, error bigint, scanned bigint" if last else "x array<int>, code binary, bounds binary, sums array<bigint>, scanned bigint")
        seen = [c for c in state.columns if c not in ("sums", "scanned")]
        rows = state.select(seen) if turn == 0 else state.where("x is not null").select(seen)
        done = materialize(rows.mapInArrow(_pass(now, width, arrow, last), out), f"codebooks-{turn}")
        if turn:
            release(spark, state)
        state = done
        if not last:
            before, step = books, now.step
            books = lloyd.moved(books, lloyd.total(state, "sums", (*books.shape[:2], 1 + books.shape[2])))
    found = state.where("code is not null").select(F.col("row_id").alias(row_id), F.col("label").alias(label), "code", "error")
    return found, books


def _arrow(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind["label"].dataType)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the error summed over rows of equal label (nulls together; null past a long).

    Labels are summed before anything is joined; a label that holds many rows is split by the join.
    """
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: float = 256.0) -> DataFrame:
    """coded with decoded, the vector of the entries that its code names: the middle of their integer cells."""
    parts = len(books)

    @F.pandas_udf("array<double>")
    def vector(code: pd.Series) -> pd.Series:
        m = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), parts)
        return pd.Series(list(((books[np.arange(parts), m] + 0.5) / scale).reshape(len(code), -1)))

    return coded.withColumn("decoded", vector("code"))
