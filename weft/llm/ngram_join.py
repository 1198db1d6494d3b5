"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's tokens are its distinct word shingles in one global order, rare ones first. Two documents with
Jaccard similarity t share at least l tokens among the first |x| - ceil(t |x|) + l of each, for any l. Each document
picks the l whose prefix has the least estimated cost (matching tokens, and candidates left to verify), so
documents with frequent tokens lengthen their prefix and ask for correspondingly more shared tokens. For a pair,
both sizes say how much it has to have in common, which is more than either alone: matches count as far as the prefixes
that this leaves.

The order comes from a count sketch of fixed size over all documents: a larger corpus raises noise and counts
alike. Any order gives the same links; a good one gives fewer candidates.

Documents with equal token sets are one class. What is wanted is the components of the link graph, so pairs inside
one known component need no check. Rounds of star links come first: each class is compared with the best of its
tokens' pivots, and a token's pivot is the class whose tokens are the most frequent ones on average, as an original
is among its edited copies. A round is linear in the postings. An exact join then takes all pairs of classes that
lie in different components and pass the prefix and size filters; the l of each class is chosen for what is left to
match then, so it does not grow with a group that is one component already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize, per_batch, release, tune
from weft.llm.textnum import LOWER, chunks, mix64, run_hash, shingles, utf8, words
from weft.operators.components import connected_components

#: The longest prefix extension: candidates may be asked for up to so many shared tokens.
MOST = 6
#: Cost of verifying a candidate against that of matching a token.
VERIFY_COST = 30
#: Star rounds go on while one in so many of the pairs that they try is a link; the join does the rest.
STAR_YIELD, STAR_ROUNDS = 20, 8
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Cells of a set's bitmap.
BITS = 1024
_U = np.uint64
Save = Callable[[DataFrame], DataFrame]


def document_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of one with under n words, its whole sequence."""
    raw, off = utf8(column)
    for lo, hi in chunks(off):
        w = words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], LOWER)
        code, first = shingles(w, n)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if a == b:
                count = w.first[d + 1] - w.first[d]
                yield run_hash(w.hash, np.array([w.first[d]]), int(count)) if count else code[:0]
            else:
                yield np.unique(code[a:b])


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """log2 of the number of documents with a token in each of 2**SKETCH_BITS cells, over all documents."""
    blocks, width = 1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS
    schema = pa.schema([("block", pa.int32()), ("bytes", pa.int32()), ("counts", pa.binary())])

    def rows(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if counts:
            # As narrow as the largest count of a block allows.
            small = [c.astype(np.min_scalar_type(int(c.max()))) for c in counts.values()]
            yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array([c.itemsize for c in small], pa.int32()), pa.array([c.tobytes() for c in small], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in document_sets(b.column(0), n):
                if total is None:
                    total = np.zeros(1 << SKETCH_BITS, np.uint32)
                np.add.at(total, (s >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total is not None:
            yield from rows({k: part for k, part in enumerate(total.reshape(blocks, width))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, size, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                total[k] = total.get(k, np.uint64(0)) + np.frombuffer(c, f"u{size}").astype(np.uint64)
        yield from rows({k: np.log2(c + 1.0).astype(np.uint8) for k, c in total.items()})

    made = docs.select("text").mapInArrow(count, "block int, bytes int, counts binary").repartition("block").mapInArrow(add, "block int, bytes int, counts binary")
    levels = np.zeros((blocks, width), np.uint8)
    for r in made.collect():  # 2**SKETCH_BITS bytes, whatever the corpus
        levels[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.reshape(-1)


def _tokens(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens that sort by the sketch's level, then by hash."""
    return np.sort((levels[(hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _U(56)) | (hashes >> _U(8)))


def _bitmap(s: np.ndarray) -> bytes:
    """For each of BITS cells whether it holds an odd number of the set's tokens."""
    return np.packbits((np.bincount((s & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def _prefixes(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, s1, s2, central, bits, prefix) of each row.

    s1 and s2 are the set's 128-bit signature, central its tokens' mean level, prefix the longest one.
    """
    one, two = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        size, s1, s2, central, bits, flat, offsets = [], [], [], [], [], [], [0]
        for s in document_sets(b.column("text"), n):
            k = len(s)
            size.append(k)
            s1.append(int(mix64(s ^ one).sum(dtype=np.uint64).astype(np.int64)))
            s2.append(int(mix64(s ^ two).sum(dtype=np.uint64).astype(np.int64)))
            keep = min(k, k - -(-percent * k // 100) + MOST)
            tokens = _tokens(s, levels)
            central.append(float((tokens >> _U(56)).mean()) if k else 0.0)
            bits.append(_bitmap(s))
            if k:
                flat.append(tokens[:keep])
            offsets.append(offsets[-1] + (keep if k else 0))
        values = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
        prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
        columns = (size, pa.int64()), (s1, pa.int64()), (s2, pa.int64()), (central, pa.float64()), (bits, pa.binary())
        names = ["doc_id", "n_tokens", "s1", "s2", "central", "bits", "prefix"]
        return pa.record_batch([b.column("doc_id"), *(pa.array(*c) for c in columns), prefix], names=names)

    schema = "doc_id bigint, n_tokens bigint, s1 bigint, s2 bigint, central double, bits binary, prefix array<bigint>"
    return docs.mapInArrow(per_batch(batch), schema)


@dataclass
class Classes:
    """What verifies pairs of classes: marks (rep, n_tokens, bits) and the texts of the corpus."""

    marks: DataFrame
    rows: DataFrame
    n: int
    percent: int
    save: Save

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that bitmaps don't rule out: sets differ in at least as many tokens as their bitmaps do in bits."""
        percent = self.percent
        left = self.marks.toDF("x", "nx", "bx")
        right = self.marks.toDF("y", "ny", "by")

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("bx", "by")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)
            total = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            return b.select(["x", "y"]).filter(pa.array(apart * (100 + percent) <= total * (100 - percent)))

        joined = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "bx", "by")
        return joined.mapInArrow(per_batch(batch), "x bigint, y bigint")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y), those whose sets have percent of their union in common.

        Whole sets are made of, and move for, those classes only that have a possible pair.
        """
        percent, n, spark = self.percent, self.n, pairs.sparkSession

        def as_sets(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s.tobytes() for s in document_sets(b.column("text"), n)]
            return pa.record_batch([b.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "tokens"])

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for tx, ty in zip(b.column("tx"), b.column("ty")):
                both = np.concatenate([np.frombuffer(tx.as_buffer(), np.uint64), np.frombuffer(ty.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            return b.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

        pairs = self.save(self._possible(pairs))
        ends = self.save(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct())
        sets = self.save(self.rows.join(ends, "doc_id", "left_semi").mapInArrow(per_batch(as_sets), "rep bigint, tokens binary"))
        release(spark)
        joined = pairs.join(sets.toDF("x", "tx"), "x").join(sets.toDF("y", "ty"), "y").select("x", "y", "tx", "ty")
        found = self.save(joined.mapInArrow(per_batch(batch), "x bigint, y bigint"))
        release(spark, pairs, ends, sets)
        return found


def jaccard_components(docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Return one row per input row: row_id, n_shingles, component_id (least id reachable by links, itself included).

    Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased; shingles are runs of n words,
    compared by 64-bit hashes. Rows link when 100 * intersection >= percent * union. Null, empty and wordless texts
    have no shingles and link with nothing. Rows that repeat an id are one vertex; rows without id link with nothing
    unless an equal text has one. An empty table gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    tune(spark)
    save = lambda df: materialize(df, "ngram")
    rows = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    levels = _sketch(rows, n)
    release(spark)
    prefixes = save(_prefixes(rows, n, percent, levels))
    narrow = save(prefixes.select("doc_id", "n_tokens", "s1", "s2"))
    classes = save(prefixes.where("n_tokens > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    # The id as part of the key spreads a large class.
    reps = prefixes.where("n_tokens > 0").withColumnRenamed("doc_id", "rep").join(classes, ["s1", "s2", "rep"])
    reps = save(reps.select("rep", "n_tokens", "central", "bits", "prefix").dropDuplicates(["rep", "n_tokens", "bits", "prefix"]))
    release(spark, prefixes)
    marks = save(reps.select("rep", "n_tokens", "bits", "central"))
    shared = _shared(reps, percent, save)
    release(spark, reps)
    marks, all_marks = save(marks.join(shared.select("rep").distinct(), "rep", "left_semi")), marks
    release(spark, all_marks)
    known = Classes(marks.drop("central"), rows, n, percent, save)
    labels = _stars(shared, marks, known)
    rest = known.verified(_candidates(shared, labels, percent, save))
    release(spark, shared)
    # Twins may be classes that share no token with another one.
    named = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    labels = save(named.select("s1", "s2", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("component")))
    grouped = _merged(labels, rest.unionByName(_twins(narrow, classes, save)), save).select("s1", "s2", F.col("component").alias("component_id"))
    columns = lambda component: (F.col("doc_id").alias(row_id), F.col("n_tokens").alias("n_shingles"), F.col(component).alias("component_id"))
    linked = narrow.where("n_tokens > 0").join(grouped, ["s1", "s2"], "left").select(*columns("component_id"))
    # Rows without words have one key: they aren't joined.
    return linked.unionByName(narrow.where("n_tokens = 0").select(*columns("doc_id")))


def _twins(narrow: DataFrame, classes: DataFrame, save: Save) -> DataFrame:
    """Links (x, y) of the classes that rows of one id belong to: a repeated id is one vertex."""
    rows = narrow.where("n_tokens > 0 and doc_id is not null")
    repeated = rows.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("doc_id")
    ends = save(rows.join(repeated, "doc_id", "left_semi").join(classes, ["s1", "s2"]).select("doc_id", "rep"))
    least = ends.groupBy("doc_id").agg(F.min("rep").alias("y"))
    return ends.join(least, "doc_id").where("rep <> y").select(F.col("rep").alias("x"), "y")


def _small(percent: int) -> int:
    """Sets of fewer tokens have partners with which they share less than the longest extension asks for."""
    return max(2 * MOST, -(-100 * MOST // percent))


def _extensions(percent: int) -> tuple[Column, Column]:
    """The least extension whose prefix holds a posting's token: against any partner, and against one not smaller.

    The latter has to have more in common. Postings are moved without them, as they follow from n_tokens and pos.
    """
    size = F.col("n_tokens")
    unextended = size - F.ceil(F.lit(percent) * size / 100)
    held = size - F.ceil(F.lit(2 * percent) * size / (100 + percent))
    level = lambda free: F.greatest(F.lit(1), F.col("pos") + 1 - free).cast("int")
    return level(unextended), level(held)


def _shared(reps: DataFrame, percent: int, save: Save) -> DataFrame:
    """(rep, n_tokens, token, pos): the tokens of prefixes that can take part in a match."""
    shared = reps.select("rep", "n_tokens", F.posexplode("prefix").alias("pos", "token"))
    level, _ = _extensions(percent)
    # A class needs l shared tokens in each prefix l; without some, tokens of others fall away.
    for _ in range(2):
        counts = save(shared.groupBy("token").agg(F.count("*").alias("cnt")).where("cnt > 1").select("token"))
        release(reps.sparkSession)
        shared = save(shared.join(counts, "token", "left_semi"))
        release(reps.sparkSession)
        held_at = [F.count(F.when(level <= k, 1)).alias(f"n{k}") for k in range(1, MOST + 1)]
        possible = shared.groupBy("rep").agg(*held_at, F.max("n_tokens").alias("nt"))
        # An extension can't ask for more tokens than a partner must have in common.
        enough = F.lit(True)
        for k in range(1, MOST + 1):
            enough = enough & ((F.col(f"n{k}") >= k) | (F.col("nt") < _small(percent)))
        whole, shared = shared, save(shared.join(save(possible.where(enough & (F.col("n1") > 0)).select("rep")), "rep", "left_semi"))
        release(reps.sparkSession, whole)
    return shared


def _stars(shared: DataFrame, marks: DataFrame, known: Classes) -> DataFrame:
    """Labels (id, component) of classes: the components of their links with pivots."""
    save, percent = known.save, known.percent
    # A repeated id has several sets and is one vertex.
    labels = save(marks.groupBy(F.col("rep").alias("id"), F.col("rep").alias("component")).agg(F.max("central").alias("central")))
    for k in range(STAR_ROUNDS):
        at = shared.join(labels.withColumnRenamed("id", "rep"), "rep")
        # The first round's pivots are the most central classes, later ones those of components in hashed order.
        turn = F.lit(0) if k == 0 else F.xxhash64("component", F.lit(k))
        key = F.struct(turn, -F.col("central"), F.col("n_tokens"), F.col("rep"), F.col("component"))
        pivots = at.groupBy("token").agg(F.min(key).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        pivots = save(
            pivots.where("lo < hi").select("token", F.col("p.rep").alias("y"), F.col("p.component").alias("yc"), F.col("p.n_tokens").alias("yn"))
        )
        sized = F.lit(100) * F.least("n_tokens", "yn") >= F.lit(percent) * F.greatest("n_tokens", "yn")
        star = at.join(pivots, "token").where(sized & (F.col("component") != F.col("yc"))).groupBy(F.col("rep").alias("x"), "y").agg(F.count("*").alias("c"), F.max("n_tokens").alias("n"))
        # A pair with fewer of them than the longest extension asks for is hardly a link; if it is, the join finds it.
        star = star.where((F.col("c") >= MOST) | (F.col("n") < _small(percent)))
        star = save(star.groupBy("x").agg(F.max(F.struct("c", "y")).alias("best")).select("x", F.col("best.y").alias("y")))
        found = known.verified(star)
        linked = found.count()
        if linked:
            labels = _merged(labels, found, save)
        if linked * STAR_YIELD < star.count() or not linked:
            break
    return labels


def _candidates(shared: DataFrame, labels: DataFrame, percent: int, save: Save) -> DataFrame:
    """All pairs (x, y) of classes in different components that pass the filters; x is not smaller than y."""
    level, hold = _extensions(percent)
    at = shared.join(labels.select(F.col("id").alias("rep"), "component"), "rep")
    # How many classes outside of a component hold a token, by extension.
    held = [F.count(F.when(hold <= k, 1)).alias(f"c{k}") for k in range(1, MOST + 1)]
    inside = save(at.groupBy("token", "component").agg(*held))
    sums = [F.sum(f"c{k}").alias(f"n{k}") for k in range(1, MOST + 1)]
    mixed = inside.groupBy("token").agg(*sums, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
    outside = inside.join(save(mixed), "token").select("token", "component", *[(F.col(f"n{k}") - F.col(f"c{k}")).alias(f"r{k}") for k in range(1, MOST + 1)])
    at = save(at.join(outside, ["token", "component"]))
    release(shared.sparkSession)
    rows = [F.sum(F.when(hold <= k, F.col(f"r{k}")).otherwise(0)).alias(f"m{k}") for k in range(1, MOST + 1)]
    # Candidates of an extension are at most its matches over l, and at most those of a shorter one.
    left = [F.array_min(F.array(*[F.col(f"m{j}") / j for j in range(1, k + 1)])) for k in range(1, MOST + 1)]
    costs = F.array(*[F.struct((F.col(f"m{k}") + VERIFY_COST * left[k - 1]).alias("cost"), F.lit(k).alias("l")) for k in range(1, MOST + 1)])
    chosen = at.groupBy("rep").agg(*rows, F.max("n_tokens").alias("nt"))
    chosen = save(chosen.select("rep", F.when(F.col("nt") < _small(percent), F.lit(1)).otherwise(F.array_min(costs)["l"]).alias("l")))

    # x asks, y is not larger; their size classes are equal or neighbours. The classes are a little wider than the
    # size filter, so that rounding can't part sizes at its edge.
    base = F.floor(F.log(F.col("n_tokens").cast("double")) / float(max(-np.log(percent / 100.0), 1e-3) * 1.001)).cast("int")
    at = at.select("rep", "n_tokens", "token", "pos", level.alias("level"), hold.alias("hold"), "component", base.alias("band"))
    asks = at.join(chosen, "rep").where("level <= l").select(
        "token",
        F.col("rep").alias("x"),
        F.col("n_tokens").alias("nx"),
        F.col("pos").alias("px"),
        "l",
        F.col("component").alias("cx"),
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
    )
    holds = at.where(F.col("hold") <= MOST).select(
        "token", F.col("rep").alias("y"), F.col("n_tokens").alias("ny"), F.col("pos").alias("py"), "hold", F.col("component").alias("cy"), "band"
    )
    # What this pair has to have in common, by both sizes, leaves shorter prefixes than each size alone.
    common = F.floor((F.lit(percent) * (F.col("nx") + F.col("ny")) + (99 + percent)) / (100 + percent))
    fits = (
        (F.lit(100) * F.col("ny") >= F.lit(percent) * F.col("nx"))
        & (F.col("px") < F.col("nx") - common + F.col("l"))
        & (F.col("py") < F.col("ny") - common + F.col("l"))
    )
    matched = asks.join(holds, ["token", "band"]).where("cx <> cy and (nx > ny or (nx = ny and x > y)) and hold <= l").where(fits)
    return matched.groupBy("x", "y", "l").agg(F.count("*").alias("c")).where("c >= l").select("x", "y")


def _merged(labels: DataFrame, links: DataFrame, save: Save) -> DataFrame:
    """Labels (id, component, ...) when components with links (x, y) between them have become one, named by the least.

    Whatever the order of ids, no two components that a link connects stay apart: the exact join would match the
    members of both with each other.
    """
    lx, ly = (labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")) for end in "xy")
    between = links.join(lx, "x").join(ly, "y").where("cx <> cy").select("cx", "cy")
    least = connected_components(between, save, "cx", "cy").toDF("component", "least")
    others = [c for c in labels.columns if c != "component"]
    return save(labels.join(least, "component", "left").select(*others, F.coalesce("least", "component").alias("component")))
