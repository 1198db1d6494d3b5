"""Node embeddings: hashed random walks, co-occurrence, PPMI and truncated SVD; spectral embeddings; pair operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import hashing, vectors
from weft.operators import blocks
from weft.operators import graph as G

Save = Callable[[DataFrame], DataFrame]


#: Steps of first-order walks between two tables; those in between are one plan.
SAVE_STEPS = 5


def paths(edges: DataFrame, save: Save, per_node: int = 8, length: int = 15, seed: int = 42) -> DataFrame:
    """(start, walk, path): the same walks as `walks` with p = q = 1, each as the array of its nodes.

    Several steps are one plan, and a walk stays one row.
    """
    deg = G.degree(edges)
    ranked = G.adjacency(edges).withColumn("i", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)
    # A step brings the degree of the node it leads to along.
    indexed = save(ranked.join(deg.toDF("dst", "d"), "dst").select(F.col("src").alias("node"), "i", "dst", "d"))
    ids = deg.select(F.col("id").alias("start"), "d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_node - 1).cast("bigint"))).alias("walk"))
    now = save(ids.select("start", "walk", F.array("start").alias("path"), F.col("start").alias("node"), "d"))
    for step in range(1, length):
        pick = now.withColumn("i", hashing.index(F.col("d"), seed, "walk", "start", "walk", F.lit(step))).drop("d")
        now = pick.join(indexed.hint("merge"), ["node", "i"]).select("start", "walk", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), "d")
        if step % SAVE_STEPS == 0 or step == length - 1:
            now = save(now)
    return now.select("start", "walk", "path")


def walks(edges: DataFrame, save: Save, per_node: int = 8, length: int = 15, seed: int = 42, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(start, walk, step, node): walks of `length` nodes from every node, each step drawn by MD5.

    With p = q = 1, and at the first step, neighbours are equally likely; else a step back weighs 1/p, one to
    a common neighbour of both last nodes 1, others 1/q.
    """
    if p == q == 1:
        return paths(edges, save, per_node, length, seed).select("start", "walk", F.posexplode("path").alias("step", "node"))
    ranked = G.adjacency(edges).withColumn("i", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)
    deg = G.degree(edges)
    # A step brings the degree of the node it leads to along.
    indexed = save(ranked.join(deg.toDF("dst", "d"), "dst").select("src", "dst", "i", "d"))
    at = deg.select(F.col("id").alias("start"), "d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_node - 1).cast("bigint"))).alias("walk"))
    now = save(at.select("start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"), F.lit(None).cast("bigint").alias("last"), "d"))
    out = now.select("start", "walk", "step", "node")
    second = save(transition_probs(edges, p, q))
    for step in range(1, length):
        if step == 1:
            pick = now.withColumn("i", hashing.index(F.col("d"), seed, "walk", "start", "walk", F.lit(step)))
            moved = pick.drop("d").join(indexed.select(F.col("src").alias("node"), "i", "dst", "d").hint("merge"), ["node", "i"]).select("start", "walk", F.lit(step).alias("step"), F.col("dst").alias("node"), F.col("node").alias("last"), "d")
        else:
            x = hashing.uniform(seed, "walk", "start", "walk", F.lit(step))
            options = now.withColumn("x", x).join(second.toDF("last", "node", "dst", "p", "upto"), ["last", "node"])
            first = options.where("upto > x").groupBy("start", "walk").agg(F.min(F.struct("upto", "dst", "node")).alias("m"))
            moved = first.select("start", "walk", F.lit(step).alias("step"), F.col("m.dst").alias("node"), F.col("m.node").alias("last"))
        now = save(moved)
        out = out.unionByName(now.select("start", "walk", "step", "node"))
    return out


def rejection_walks(edges: DataFrame, save: Save, per_node: int = 8, length: int = 15, seed: int = 42, p: float = 1.0, q: float = 1.0, trials: int = 8) -> DataFrame:
    """(start, walk, step, node): second-order walks without a table of transitions.

    A step tries neighbours, equally likely, by MD5, and takes one with its weight (1/p back, 1 to a common
    neighbour of both last nodes, 1/q else) over the largest weight; the first one taken is the step. `trials` at a
    time are looked at for the walks that still wait, so rows follow the walks, not the squares of degrees. Tables of
    the graph are never broadcast: each step would send them through the driver again.
    """
    ranked = G.adjacency(edges).withColumn("i", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)
    deg = G.degree(edges)
    indexed = save(ranked.join(deg.toDF("dst", "d"), "dst").select("src", "dst", "i", "d"))
    near = indexed.select(F.col("src").alias("last"), F.col("dst").alias("next"), F.lit(True).alias("near"))
    at = deg.select(F.col("id").alias("start"), "d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_node - 1).cast("bigint"))).alias("walk"))
    now = save(at.select("start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"), F.lit(None).cast("bigint").alias("last"), "d"))
    out, top = now.select("start", "walk", "step", "node"), max(1.0, 1.0 / p, 1.0 / q)
    for step in range(1, length):
        waiting, moved, first = now, None, 0
        while True:
            tried = waiting.withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1))))
            tried = tried.withColumn("i", hashing.index(F.col("d"), seed, "pick", "start", "walk", F.lit(step), "trial"))
            found = tried.drop("d").join(indexed.select(F.col("src").alias("node"), "i", F.col("dst").alias("next"), "d").hint("merge"), ["node", "i"]).join(near.hint("merge"), ["last", "next"], "left")
            weight = F.when(F.col("last").isNull(), top).when(F.col("next") == F.col("last"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
            taken = found.where(hashing.uniform(seed, "take", "start", "walk", F.lit(step), "trial") * top < weight)
            least = save(taken.groupBy("start", "walk").agg(F.min(F.struct("trial", "next", "node", "d")).alias("m")))
            new = least.select("start", "walk", F.lit(step).alias("step"), F.col("m.next").alias("node"), F.col("m.node").alias("last"), F.col("m.d").alias("d"))
            moved = new if moved is None else moved.unionByName(new)
            waiting, first = save(waiting.join(least.select("start", "walk").hint("merge"), ["start", "walk"], "left_anti")), first + trials
            if waiting.isEmpty():
                break
        now = save(moved)
        out = out.unionByName(now.select("start", "walk", "step", "node"))
    return out


def transition_probs(edges: DataFrame, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(prev, curr, next, prob, upto): second-order probabilities, and their running sum in order of next."""
    adj = G.adjacency(edges)
    steps = adj.toDF("prev", "curr").join(adj.toDF("curr", "next"), "curr")
    near = adj.toDF("prev", "next").withColumn("near", F.lit(True))
    weighed = steps.join(near, ["prev", "next"], "left").withColumn("w", F.when(F.col("next") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q))
    every = W.partitionBy("prev", "curr")
    upto = F.sum("w").over(every.orderBy("next").rowsBetween(W.unboundedPreceding, 0))
    return weighed.select("prev", "curr", "next", (F.col("w") / F.sum("w").over(every)).alias("prob"), (upto / F.sum("w").over(every)).alias("upto"))


def cooccurrence(steps: DataFrame, window: int = 3) -> DataFrame:
    """(a, b, n): how often b stands within `window` steps of a on a walk, both directions.

    A walk is one array, so neighbours on it are found without a shuffle by position.
    """
    line = steps.groupBy("start", "walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("w"))
    return together(line.select(F.col("w.node").alias("path")), window)


def together(lines: DataFrame, window: int = 3) -> DataFrame:
    """(a, b, n) as cooccurrence has it, of arrays of nodes lines(path): each two places are looked at once, from the
    earlier one, and counted without regard to order; both directions come from the counts."""
    ahead = lines.select(F.posexplode("path").alias("i", "x"), "path").select("x", F.explode(F.slice("path", F.col("i") + 2, window)).alias("y"))
    half = ahead.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("n"))
    way = lambda a, b, n: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"))
    n = F.col("n")
    both = F.when(F.col("x") == F.col("y"), F.array(way("x", "y", 2 * n))).otherwise(F.array(way("x", "y", n), way("y", "x", n)))
    return half.select(F.inline(both))


def ppmi(counts: DataFrame, as_coded: bool = False) -> DataFrame:
    """(a, b, ppmi) of co-occurring pairs, positive ones only.

    as_coded: the published variant, whose expectation is divided by the total once more (PMI + ln total).
    """
    total = counts.agg(F.sum("n").cast("double").alias("t"))
    rows = counts.groupBy("a").agg(F.sum("n").cast("double").alias("ra"))
    full = counts.join(rows, "a").join(rows.toDF("b", "rb"), "b").crossJoin(F.broadcast(total))  # one row
    n, expected = F.col("n").cast("double"), F.col("ra") * F.col("rb") / F.col("t")
    share = n * F.col("t") / (expected + 1e-9) if as_coded else n / expected
    return full.select("a", "b", F.log(F.greatest(share, F.lit(1e-9))).alias("ppmi")).where("ppmi > 0")


def svd_embed(entries: DataFrame, save: Save, dim: int = 16) -> DataFrame:
    """(id, z): rows of U * sqrt(S) of the sparse matrix entries(a, b, value), of unit length; singular values descend."""
    found, values = blocks.singular(entries, dim, save)
    return unit(blocks.times(found, np.diag(np.sqrt(values))))


def unit(block: DataFrame) -> DataFrame:
    """Rows (id, y) as z of length 1; zeros stay."""
    length = vectors.norm(F.col("y"))
    return block.select("id", F.transform("y", lambda x: x / F.when(length > 0, length).otherwise(1.0)).alias("z"))


def node_embeddings(edges: DataFrame, save: Save, dim: int = 16, per_node: int = 8, length: int = 15, seed: int = 42) -> DataFrame:
    """Walks, co-occurrence, PPMI, SVD; a graph without co-occurrence uses its adjacency."""
    found = save(ppmi(save(together(paths(edges, save, per_node, length, seed)))))
    if found.isEmpty():
        found = save(G.adjacency(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("ppmi")))
    return svd_embed(found.withColumnRenamed("ppmi", "value"), save, dim)


def spectral_embed(edges: DataFrame, save: Save, dim: int = 16, low: bool = True) -> DataFrame:
    """(id, z): eigenvectors of the normalised Laplacian, rows of unit length. low: of its least eigenvalues but the first
    (those of the largest of I + D^-1/2 A D^-1/2); else of its largest but the first."""
    found, values, _ = blocks.leading_eigen(save(laplacian(edges, low)), dim + 1, 2.0, save)
    return unit(blocks.times(found, np.eye(len(values))[:, 1:]))


def laplacian(edges: DataFrame, low: bool = True) -> DataFrame:
    """(a, b, value) of I + D^-1/2 A D^-1/2, or with low false of I - D^-1/2 A D^-1/2."""
    deg = G.degree(edges)
    adj = G.adjacency(edges).join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    off = adj.select(F.col("src").alias("a"), F.col("dst").alias("b"), ((1.0 if low else -1.0) / F.sqrt((F.col("ds") * F.col("dd")).cast("double"))).alias("value"))
    return off.unionByName(deg.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("value")))


EMBEDDING = ("emb_cosine_sim", "emb_l1_dist", "emb_l2_dist", "emb_dot_product")


def edge_embedding_features(pairs: DataFrame, embeddings: DataFrame, dim: int, hadamard: int = 8) -> DataFrame:
    """pairs(u, v, ...) with cosine, L1, L2, dot and the first Hadamard products of embeddings(id, z).

    Missing nodes are zero vectors.
    """
    full = pairs.join(embeddings.toDF("u", "_zu"), "u", "left").join(embeddings.toDF("v", "_zv"), "v", "left")
    full = full.withColumn("_zu", vectors.or_zero(F.col("_zu"), dim)).withColumn("_zv", vectors.or_zero(F.col("_zv"), dim))
    a, b = F.col("_zu"), F.col("_zv")
    return full.select(*pairs.columns, *_measures(a, b, min(dim, hadamard)))


#: Rows of one part of a group; each part meets each part of its group in one task, so a row is sent once a part.
GROUP_PART = 4096
#: Parts of a group of fewer rows, of so many rows at least: meetings are what tasks share.
LEAST_PARTS, LEAST_ROWS = 8, 256
#: Pairs that are measured, and handed over, at once.
PAIRS_AT_ONCE = 1 << 14
#: Tasks that parts are dealt to at most.
MOST_TASKS = 2048


def group_embedding_features(embeddings: DataFrame, dim: int, hadamard: int = 8, columns: tuple[str, ...] | None = None, digits: int | None = None) -> DataFrame:
    """(u, v) with the same features for all pairs u < v of one group of embeddings(id, group, z), without nulls in group.

    Vectors are joined by parts of their groups, so pairs are made where both vectors are and never move; what moves
    are the vectors, once for each part of their group. A task has two parts at a time in memory, and measures many
    pairs at once, component by component: sums are those of `vectors`. columns: those that are asked for, by default
    all; digits: places that they are rounded to. A vector of another length, or with a null in it, has no measures.
    embeddings is read twice.
    """
    embeddings = embeddings.where("id is not null")
    columns = (*EMBEDDING, *(f"emb_hadamard_{k}" for k in range(min(dim, hadamard)))) if columns is None else columns
    sizes = embeddings.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / GROUP_PART), F.least(F.lit(LEAST_PARTS), F.floor(F.count("*") / LEAST_ROWS))).cast("int").alias("_parts"))
    tasks = sizes.agg(F.sum(F.col("_parts") * (F.col("_parts") + 1) / 2)).first()[0] or 1
    dealt = embeddings.select("id", "group", vectors.or_zero(F.col("z"), dim).alias("z")).join(sizes, "group")
    fits = (F.size("z") == dim) & ~F.exists("z", lambda x: x.isNull())
    dealt = dealt.withColumn("_fits", fits).withColumn("z", F.when(fits, F.col("z")).otherwise(vectors.or_zero(F.lit(None), dim))).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # Each two parts (low, high) meet once; rows of a meeting come one after the other, those of the lower part first.
    met = dealt.select(F.xxhash64("group").alias("_g"), "group", F.least("_p", "_q").alias("low"), F.greatest("_p", "_q").alias("high"), "_p", "id", "z", "_fits")
    met = met.repartition(int(min(tasks, MOST_TASKS)), "group", "low", "high").sortWithinPartitions("group", "low", "high", "_p", "id")
    return met.select("_g", "low", "high", "_p", "id", "z", "_fits").mapInArrow(_pairs_of_parts(dim, columns, digits), ", ".join(["u bigint", "v bigint", *(f"{c} double" for c in columns)]))


def _pairs_of_parts(dim: int, columns: tuple[str, ...], digits: int | None):  # noqa: ANN202
    names = ["u", "v", *columns]

    def measured(ids: np.ndarray, z: np.ndarray, part: np.ndarray, fits: np.ndarray) -> Iterator[pa.RecordBatch]:
        second = np.flatnonzero(part != part[0])
        a = slice(0, second[0] if len(second) else len(ids))
        b = slice(second[0], len(ids)) if len(second) else a
        across = np.ascontiguousarray(z[b].T)
        lengths = np.sqrt(_summed(dim, lambda k: z[:, k] * z[:, k], len(ids))) if "emb_cosine_sim" in columns else None
        step = max(1, PAIRS_AT_ONCE // max(1, b.stop - b.start))
        for at in range(a.start, a.stop, step):
            rows = slice(at, min(at + step, a.stop))
            x, size = z[rows], (rows.stop - rows.start, b.stop - b.start)
            # Within a part a pair comes up in both orders, between two parts in one; the lesser id is u.
            left, right = np.broadcast_to(ids[rows][:, None], size), np.broadcast_to(ids[b][None], size)
            keep = left < right if a == b else left != right
            if not keep.any():
                continue
            values = {}
            if {"emb_cosine_sim", "emb_dot_product"} & set(columns):
                values["emb_dot_product"] = _summed(dim, lambda k: x[:, k, None] * across[k], size)
            if "emb_cosine_sim" in columns:
                both = lengths[rows][:, None] * lengths[b][None]
                values["emb_cosine_sim"] = np.divide(values["emb_dot_product"], both, out=np.zeros(size), where=both > 0)
            if "emb_l1_dist" in columns:
                values["emb_l1_dist"] = _summed(dim, lambda k: np.abs(x[:, k, None] - across[k]), size)
            if "emb_l2_dist" in columns:
                values["emb_l2_dist"] = np.sqrt(_summed(dim, lambda k: np.square(x[:, k, None] - across[k]), size))
            values |= {c: x[:, k, None] * across[k] for c in columns if c.startswith("emb_hadamard_") for k in (int(c.rsplit("_", 1)[1]),)}
            u, v = np.minimum(left, right)[keep], np.maximum(left, right)[keep]
            none = None if fits.all() else ~(fits[rows][:, None] & fits[b][None])[keep]
            yield pa.record_batch([pa.array(u), pa.array(v), *(pa.array(_places(values[c][keep], digits), mask=none) for c in columns)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("_g", "low", "high")])
            part, ids, fits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_p", "id", "_fits"))
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if last > first:
                    if now is not None and now != tuple(keys[:, first]):
                        yield from measured(*(np.concatenate(c) for c in zip(*held)))
                        held = []
                    now = tuple(keys[:, first])
                    held.append((ids[first:last], z[first:last], part[first:last], fits[first:last]))
        if held:
            yield from measured(*(np.concatenate(c) for c in zip(*held)))

    return task


def _summed(dim: int, each: Callable[[int], np.ndarray], size: int | tuple[int, int]) -> np.ndarray:
    """The sum over components, in their order."""
    total = np.zeros(size)
    for k in range(dim):
        total += each(k)
    return total


def _places(x: np.ndarray, digits: int | None) -> np.ndarray:
    """x rounded, halves away from 0, as SQL rounds; beyond 2**52 units nothing is to round."""
    if digits is None:
        return x
    unit = 10.0**digits
    y = np.abs(x) * unit
    whole = np.floor(y)
    return np.where(y < 2.0**52, np.copysign((whole + (y - whole >= 0.5)) / unit, x), x) + 0.0


def _measures(a: Column, b: Column, products: int) -> list[Column]:
    return [vectors.cosine(a, b).alias("emb_cosine_sim"), vectors.l1(a, b).alias("emb_l1_dist"), vectors.l2(a, b).alias("emb_l2_dist"), vectors.dot(a, b).alias("emb_dot_product"), *[(a[k] * b[k]).alias(f"emb_hadamard_{k}") for k in range(products)]]
