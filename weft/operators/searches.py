"""Breadth-first searches from all nodes of a graph, exact at any size: in tasks that hold one component each.

A component is packed to eight bytes an edge, and goes to as many tasks (shares) as its nodes times its edges ask for;
each searches from some of the nodes, a batch at a time, and hands over one row a node. So what is written grows with
the edges and the nodes, once for each share, and never with pairs of nodes. A task needs the component's edges and a
few arrays of its nodes times a batch in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.components import connected_components

Save = Callable[[DataFrame], DataFrame]
#: Shares of a component at most.
MOST_SHARES = 256
#: Numbers of an array of nodes times a batch, and bytes of rows that are merged at once.
CELLS, GATHERED = 1 << 20, 1 << 18
_PACKED = pa.schema([("component", pa.int64()), ("shares", pa.int32()), ("nodes", pa.binary()), ("ends", pa.binary())])


class Links:
    """One component: nodes (sorted ids), and the neighbours of node k at near[start[k]:start[k + 1]]."""

    def __init__(self, nodes: bytes, ends: bytes) -> None:
        self.nodes = np.frombuffer(nodes, np.int64)
        self.n = len(self.nodes)
        pairs = np.frombuffer(ends, np.int32).reshape(-1, 2)
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        order = np.argsort(a, kind="stable")
        self.near = b[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=self.n))])

    def _edges(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in near of rows' neighbours, and where each row's begin among them."""
        first, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        return np.arange(ends[-1]) + np.repeat(first - (ends - size), size), ends - size

    def beside(self, rows: np.ndarray) -> np.ndarray:
        """Neighbours of rows, sorted; all nodes where they are many anyhow."""
        if 4 * (self.start[rows + 1] - self.start[rows]).sum() >= len(self.near):
            return np.arange(self.n)
        return np.unique(self.near[self._edges(rows)[0]])

    def over(self, merge: np.ufunc, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each of rows its neighbours' rows of state, merged. Every node has a neighbour.

        Rows go by their number of neighbours, a block at a time: first neighbours, second ones of those that have one, ...
        """
        size = self.start[rows + 1] - self.start[rows]
        order = np.argsort(-size, kind="stable")
        out = np.empty((len(rows), state.shape[1]), state.dtype)
        step = max(16, GATHERED // (state.shape[1] * state.itemsize))
        for at in range(0, len(rows), step):
            block = order[at : at + step]
            first, many = self.start[rows[block]], size[block]
            merged = state[self.near[first]]
            for j, k in enumerate(np.searchsorted(-many, -np.arange(1, many[0]), side="left"), 1):
                merge(merged[:k], state[self.near[first[:k] + j]], out=merged[:k])
            out[block] = merged
        return out


def _pack(table: pa.Table) -> pa.Table:
    """One row a component from its edges (u, v, component, shares)."""
    of = table.column("component").to_numpy()
    order = np.argsort(of, kind="stable")
    u, v, shares = (table.column(c).to_numpy()[order] for c in ("u", "v", "shares"))
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    rows = []
    for a, b in zip(first, np.r_[first[1:], len(of)]):
        nodes, ends = np.unique(np.stack([u[a:b], v[a:b]], axis=1), return_inverse=True)
        rows.append((int(of[order][a]), int(shares[a]), nodes.astype(np.int64).tobytes(), ends.reshape(-1).astype(np.int32).tobytes()))
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), _PACKED)], schema=_PACKED)


def searched(edges: DataFrame, save: Save, search: Callable[[Links, np.ndarray], Iterator[np.ndarray]], ddl: str, shares: Column, items: int | None = None) -> DataFrame:
    """Rows (id, ...) of all shares of all components: search gets a component and the places of the nodes to search from
    (with items, a share of so many numbers), and gives the columns of ddl after id, one value a node. shares: of a
    component with n nodes and m edges."""
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    placed = edges.select("u", "v").join(connected_components(edges, save).toDF("u", "component"), "u")
    placed = save(placed)
    sizes = placed.groupBy("component").agg(F.count("*").alias("m"))
    ids = placed.select("component", F.explode(F.array("u", "v")).alias("id")).distinct().groupBy("component").agg(F.count("*").alias("n"))
    sized = sizes.join(ids, "component").select("component", F.greatest(F.lit(1), shares).cast("int").alias("shares"))
    # Small components are packed, and searched, a number of them at a time.
    group = F.when(F.col("shares") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks)))
    cut = placed.join(sized, "component").withColumn("_group", group).repartition(tasks, "_group")
    packed = save(cut.groupBy("_group").applyInArrow(_pack, "component bigint, shares int, nodes binary, ends binary"))
    every = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("_group", group)
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for r in range(table.num_rows):
            row = table.slice(r, 1).to_pylist()[0]
            links = Links(row["nodes"], row["ends"])
            first, last = ((items or links.n) * k // row["shares"] for k in (row["share"], row["share"] + 1))
            found = list(search(links, np.arange(first, last)))
            out.append(pa.table([links.nodes, *found], names=["id", *names]))
        return pa.concat_tables(out)

    return every.repartition(tasks, "_group", "share").groupBy("_group", "share").applyInArrow(run, f"id bigint, {ddl}")


def by_work(work: int) -> Column:
    """A share for so many nodes times edges."""
    return F.least(F.lit(MOST_SHARES), F.ceil(F.col("n").cast("double") * F.col("m") / work))


def hops(words: int) -> Callable[[Links, np.ndarray], Iterator[np.ndarray]]:
    """Search: sums of distances, nodes reached and the largest distance. 64 * words nodes at most make a batch, a bit each.

    A node that has a bit first in round t is t hops from the bit's node; as distances are the same both ways, the
    node counts them for itself.
    """

    def search(links: Links, sources: np.ndarray) -> Iterator[np.ndarray]:
        width = max(1, min(words, CELLS // links.n))
        s, r, far = (np.zeros(links.n, np.int64) for _ in range(3))
        for at in range(0, len(sources), 64 * width):
            batch = sources[at : at + 64 * width]
            k = np.arange(len(batch))
            seen = np.zeros((links.n, -(-len(batch) // 64)), np.uint64)
            seen[batch, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
            r[batch] += 1
            new, active, t = seen.copy(), batch, 0
            while len(active):
                t += 1
                rows = links.beside(active)
                found = links.over(np.bitwise_or, new, rows) & ~seen[rows]
                count = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                new[active] = 0
                active, found, count = rows[count > 0], found[count > 0], count[count > 0]
                new[active] = found
                seen[active] |= found
                s[active] += t * count
                r[active] += count
                far[active] = np.maximum(far[active], t)
        yield from (s, r, far)

    return search


def dependencies(links: Links, sources: np.ndarray) -> Iterator[np.ndarray]:
    """Search: Brandes' dependencies of the sources on every node, summed."""
    total = np.zeros(links.n)
    width = max(1, min(64, CELLS // links.n))
    for at in range(0, len(sources), width):
        batch = sources[at : at + width]
        dist, sigma = np.full((links.n, len(batch)), -1, np.int32), np.zeros((links.n, len(batch)))
        dist[batch, np.arange(len(batch))] = 0
        sigma[batch, np.arange(len(batch))] = 1.0
        now, levels = sigma.copy(), [batch]
        while True:
            rows = links.beside(levels[-1])
            came = links.over(np.add, now, rows)
            new = (dist[rows] < 0) & (came > 0)
            some = new.any(axis=1)
            if not some.any():
                break
            now[levels[-1]] = 0.0
            rows, new = rows[some], new[some]
            now[rows] = np.where(new, came[some], 0.0)
            dist[rows] = np.where(new, len(levels), dist[rows])
            sigma[rows] += now[rows]
            levels.append(rows)
        now[levels[-1]] = 0.0
        delta = np.zeros_like(sigma)
        for level in range(len(levels) - 1, 1, -1):
            rows, up = levels[level], levels[level - 1]
            now[rows] = np.divide(1.0 + delta[rows], sigma[rows], out=np.zeros((len(rows), len(batch))), where=dist[rows] == level)
            delta[up] += np.where(dist[up] == level - 1, sigma[up] * links.over(np.add, now, up), 0.0)
            now[rows] = 0.0
        total += delta.sum(axis=1)
    yield total


#: Registers of sketches that a task holds, a byte each.
REGISTERS = 1 << 26
STEPS = "t array<int>, zeros array<int>, low array<double>"


def slices(precision: int) -> Column:
    """Shares that split the registers of a component's sketches."""
    return F.least(F.lit(1 << precision), F.ceil(F.col("n").cast("double") * (1 << precision) / REGISTERS))


def _hashed(ids: np.ndarray) -> np.ndarray:
    """64 bits of each id (splitmix64)."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(precision: int) -> Callable[[Links, np.ndarray], Iterator[pa.Array]]:
    """Search: what HyperLogLog sketches of the nodes within t hops change by, for a share of their registers.

    A register's merging asks for no other one. Of every node, for rounds t in which any of the share changes: by how
    many the registers at 0 change, and by how much the sum of 2 ** -r over the others.
    """
    power = np.r_[0.0, 0.5 ** np.arange(1, 256)]

    def search(links: Links, registers: np.ndarray) -> Iterator[pa.Array]:
        h = _hashed(links.nodes)
        at, rest = (h & np.uint64((1 << precision) - 1)).astype(np.int64), (h >> np.uint64(precision)) | np.uint64(1 << (64 - precision))
        rank = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)) + 1
        state = np.zeros((links.n, len(registers)), np.uint8)
        mine = np.flatnonzero((at >= registers[0]) & (at <= registers[-1]))
        state[mine, at[mine] - registers[0]] = rank[mine]
        zeros, low = np.full(links.n, len(registers)), np.zeros(links.n)
        steps, active, t = [], np.arange(links.n), 0
        while len(active):
            now = state[active]
            z, x = (now == 0).sum(axis=1), np.concatenate([power[now[k : k + 1024]].sum(axis=1) for k in range(0, len(now), 1024)])
            steps.append((active, np.full(len(active), t), z - zeros[active], x - low[active]))
            zeros[active], low[active] = z, x
            t += 1
            rows = links.beside(active)
            found = np.maximum(links.over(np.maximum, state, rows), state[rows])
            some = (found != state[rows]).any(axis=1)
            active, found = rows[some], found[some]
            state[active] = found
        node, t, z, x = (np.concatenate(c) for c in zip(*steps))
        order = np.argsort(node, kind="stable")
        begins = pa.array(np.r_[0, np.cumsum(np.bincount(node, minlength=links.n))], pa.int32())
        for values, kind in ((t, pa.int32()), (z, pa.int32()), (x, pa.float64())):
            yield pa.ListArray.from_arrays(begins, pa.array(values[order], kind))

    return search


def estimated(steps: DataFrame, precision: int) -> DataFrame:
    """(id, c, far, t) of rows (id, t, zeros, low) of all shares: the estimated number of nodes that a node reaches, the
    sum of their distances, and the last round that added any. The estimator is Ertl's (2017), which has no range of its own for small counts."""
    m = 1 << precision
    share = np.arange(m + 1) / m
    small = m * (share + sum(share ** (2.0**k) * 2.0 ** (k - 1) for k in range(1, 40)))
    whole = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("t", "zeros", "low")))).alias("s")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of, s = np.repeat(np.arange(b.num_rows), b.column("s").value_lengths().to_numpy()), b.column("s").flatten()
            t, z, x = (s.field(k).to_numpy() for k in range(3))
            first = np.flatnonzero(np.r_[True, np.diff(of) != 0])
            begins = np.repeat(first, np.diff(np.r_[first, len(of)]))
            run = lambda d: (c := np.cumsum(d)) - (c - d)[begins]  # noqa: E731 - sums within a node
            last = np.r_[(np.diff(of) != 0) | (np.diff(t) != 0), True]
            of, t, z, x = of[last], t[last], (m + run(z))[last], run(x)[last]
            count = np.where(t == 0, 1.0, m * m / (2.0 * np.log(2.0)) / (small[z] + x))
            more = np.where(t == 0, 1.0, np.maximum(np.diff(count, prepend=0.0), 0.0))
            total, far = (np.bincount(of, w, b.num_rows) for w in (more, t * more))
            rounds = np.zeros(b.num_rows, np.int32)
            np.maximum.at(rounds, of, np.where(more > 0, t, 0).astype(np.int32))
            yield pa.record_batch([b.column("id"), pa.array(total), pa.array(far), pa.array(rounds)], names=["id", "c", "far", "t"])

    return steps.groupBy("id").agg(whole).mapInArrow(task, "id bigint, c double, far double, t int")
