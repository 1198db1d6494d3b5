"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item of L words with at most e edited (substituted, dropped or put in) keeps at least t = (L - n + 1) - n * e of
its n-grams, so any L - n + 1 - t + 1 of them hold one that is kept. n is three words where that leaves t at 1 or more,
else two or one. The rarest n-grams in the corpus are the item's seeds: exact counts over all documents pick them. Where a
document has a seed, the passage around it is a candidate; one that has t of the item's n-grams is aligned word
by word.

Smith-Waterman scores the alignment: a copy with e edits scores 2 * L - 3 * e at least, so less is no copy. Being local,
it leaves out words beside an item's ends where edits cluster, so it can't count the edits: that is done by fitting
the whole item into the passage, for which every word of it counts.

Benchmarks are small beside a corpus: they go to the executors in blocks of bounded items and characters, each a
stated query set against all documents. Documents are read in place, twice a block, without any shuffle but that of
the seeds' counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import materialize, tune
from weft.llm.textnum import LOWER, Words, chunks, run_hash, utf8, words

SIMILARITY = 0.8
#: Items that go to the executors at once, and characters of them (a single longer item goes alone); larger
#: benchmarks take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
SEED = 3

# Words are runs of ASCII letters and digits and of other characters: punctuation can't hide a copy.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


def _words(raw: np.ndarray, off: np.ndarray) -> Words:
    return words(raw, off, LOWER, _SEPARATOR)


@dataclass
class Items:
    """A block of items: ids, word hashes, the n-gram table and after `choose` the seeds.

    grams[n] = (sorted hashes, item of each, position of each) for items whose seeds have n words.
    """

    ids: list
    codes: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    need: np.ndarray
    edits: np.ndarray
    seed: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list, similarity: float) -> Items:
        raw, off = utf8(pa.array(texts, pa.large_string()))
        w = _words(raw, off)
        codes = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        length = np.array([len(c) for c in codes], np.int64)
        edits = np.floor(length * (1 - similarity) + 1e-9).astype(np.int64)
        size = np.ones(len(length), np.int64)
        for n in range(2, SEED + 1):
            size[length - n + 1 - n * edits >= 1] = n
        need = length - size + 1 - size * edits
        grams = {}
        for n in range(1, SEED + 1):
            of, at = [], []
            for i in np.flatnonzero((size == n) & (length > 0)):
                k = int(length[i] - n + 1)
                of.append(np.full(k, i))
                at.append(np.arange(k))
            if of:
                of, at = np.concatenate(of), np.concatenate(at)
                code = run_hash(w.hash, w.first[of] + at, n)
                order = np.argsort(code, kind="stable")
                grams[n] = code[order], of[order], at[order]
        return cls(ids, codes, grams, need, edits, {})

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Mark each item's rarest n-grams as seeds: as many as can't all be edited away."""
        for n, (code, of, at) in self.grams.items():
            seed = np.zeros(len(code), bool)
            order = np.lexsort((at, counts[n], of))
            starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            total = np.bincount(of, minlength=len(self.ids))
            seed[order] = rank < (total - self.need + 1)[of[order]]
            self.seed[n] = seed


def _along(row: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """row after gaps within it, each place costing step, and from which place each value comes."""
    ramp = np.arange(len(row), dtype=row.dtype) * step
    best = np.maximum.accumulate(row + ramp)
    return best - ramp, np.maximum.accumulate(np.where(row + ramp == best, np.arange(len(row)), 0))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman over words (match 2, mismatch and gap -1): score, matches, extra words, first and end word.

    Extra words are those of the passage between matches that the item lacks at that place. A row of the
    matrix is one step, and only the last one is kept: what is known of a cell's alignment travels with it.
    """
    m = len(passage)
    score, seen = np.zeros(m + 1, np.int32), np.zeros((3, m + 1), np.int32)  # matches, extra, first word
    seen[2] = np.arange(m + 1)
    best = (0, 0, 0, 0, 0)
    for word in item:
        same = passage == word
        diagonal, above = score[:-1] + np.where(same, 2, -1), score - 1
        row, kept = np.maximum(above, 0), seen.copy()
        kept[:2, above <= 0] = 0
        kept[2, above <= 0] = np.flatnonzero(above <= 0)
        better = np.flatnonzero(diagonal >= row[1:])
        fresh = better[diagonal[better] > 0]
        row[1:][better] = diagonal[better]
        kept[:, fresh + 1] = seen[:, fresh]
        kept[0, fresh + 1] += same[fresh]
        score, source = _along(row, 1)
        seen = kept[:, source]
        seen[1] += np.arange(m + 1, dtype=np.int32) - source.astype(np.int32)
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(seen[0, j]), int(seen[1, j]), int(seen[2, j]), j)
    return best


def fit(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn the whole item into a run of the passage, and that run's first and end word."""
    m = len(passage)
    cost, first = np.zeros(m + 1, np.int32), np.arange(m + 1)
    for word in item:
        diagonal = cost[:-1] + (passage != word)
        row, start = cost + 1, first.copy()
        better = np.flatnonzero(diagonal <= row[1:])
        row[1:][better] = diagonal[better]
        start[better + 1] = first[better]
        low, source = _along(-row, 1)
        cost, first = -low, start[source]
    j = int(cost.argmin())
    return int(cost[j]), int(first[j]), j


def _hits(codes: np.ndarray, first: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of n-grams of a chunk that are in the sorted table, and their hashes."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.arange(counts.sum()) + np.repeat(first[:-1] - np.r_[0, np.cumsum(counts)[:-1]], counts)
    code = run_hash(codes, at, n)
    place = np.minimum(np.searchsorted(table, code), len(table) - 1)
    found = table[place] == code
    return at[found], code[found]


def _near(items: Items, w: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, score, matches, first word, end word) of passages in a chunk that are copies."""
    for n, (table, of, at) in items.grams.items():
        if len(table) == 0 or len(w.hash) < n:
            continue
        position, code = _hits(w.hash, w.first, n, table)
        if not len(position):
            continue
        lo, hi = np.searchsorted(table, code, "left"), np.searchsorted(table, code, "right")
        k = np.repeat(np.arange(len(code)), hi - lo)
        entry = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        doc = np.searchsorted(w.first, position[k], "right") - 1
        item, start = of[entry], position[k] - at[entry]
        order = np.lexsort((start, item, doc))
        doc, item, start, entry, position_k = doc[order], item[order], start[order], entry[order], position[k][order]
        seeds = items.seed[n][entry]
        # One group is what one document has of one item, in order of where the item would start.
        bounds = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True])
        has_seed = np.add.reduceat(seeds, bounds[:-1]) > 0
        many = np.diff(bounds) >= items.need[item[bounds[:-1]]]
        for g in np.flatnonzero(has_seed & many):
            a, b = bounds[g], bounds[g + 1]
            d, i = int(doc[a]), int(item[a])
            length, slack, need = len(items.codes[i]), int(items.edits[i]), int(items.need[i])
            begin, best, done = start[a:b], None, -1
            for s in np.unique(begin[seeds[a:b]]):
                if s <= done:
                    continue
                # All starts that edits can shift this one to. The passage holds every copy with a seed that starts
                # up to s + slack, as its begin and end lie within slack of what its seed says.
                x, y = np.searchsorted(begin, s - 2 * slack), np.searchsorted(begin, s + 2 * slack, "right")
                done = s + slack
                if len(np.unique(entry[a + x : a + y])) < need:
                    continue
                p, q = max(int(w.first[d]), int(s) - 2 * slack), min(int(w.first[d + 1]), int(s) + length + 3 * slack)
                score = align(items.codes[i], w.hash[p:q])[0]
                if score < 2 * length - 3 * slack:
                    continue
                edits, f, e = fit(items.codes[i], w.hash[p:q])
                if edits <= slack and (best is None or (length - edits, score) > best[0]):
                    best = (length - edits, score), score, length - edits, p + f - int(w.first[d]), p + e - int(w.first[d])
            if best is not None:
                yield d, i, best[1], best[2], best[3], best[4]


_OUT = "row_id bigint, item_id bigint, similarity double, score bigint, first_word bigint, end_word bigint"


def _blocks(known: DataFrame, most_items: int, most_chars: int) -> Iterator[list]:
    """The items in blocks within both bounds, fetched a partition at a time, in an order of their own."""
    block, chars = [], 0
    for r in known.orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) == most_items or chars + len(r["text"]) > most_chars):
            yield block
            block, chars = [], 0
        block.append(r)
        chars += len(r["text"])
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    block_items: int = BLOCK_ITEMS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Return one row per row and benchmark item that it holds a copy of: row_id, item_id, similarity, score, first_word, end_word.

    similarity: 1 - edits / L, with L the item's words and edits the least number of words put in, dropped or
    substituted that turns the item into a run of the document's words; at least the threshold. score: Smith-Waterman's,
    of that passage. Words are lower-cased runs of letters and digits, so case and punctuation don't matter;
    first_word and end_word place the best passage. Null and empty texts and items match nothing; items too short for
    an edit within the threshold (under five words at 0.8) have to occur exactly; repeated rows and repeated items
    are reported each; null ids pass through. Empty tables give an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    known = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and text <> ''")
    out, held = None, None
    for block in _blocks(known, block_items, block_chars):
        # Of several blocks each is finished before the next is fetched: the driver holds one.
        if held is not None:
            done = materialize(_block(rows, held, similarity), "benchmark")
            out = done if out is None else out.unionByName(done)
        held = block
    last = _block(rows, held or [], similarity)
    return (last if out is None else out.unionByName(last)).withColumnsRenamed({"row_id": row_id, "item_id": item_id})


def _block(rows: DataFrame, block: list, similarity: float) -> DataFrame:
    items = Items.of([r["item_id"] for r in block], [r["text"] for r in block], similarity)
    tables = {n: np.unique(code) for n, (code, _, _) in items.grams.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(t), np.int64) for n, t in tables.items()}
        for b in batches:
            raw, off = utf8(b.column(0))
            for lo, hi in chunks(off):
                w = _words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for n, t in tables.items():
                    if len(w.hash) >= n:
                        _, code = _hits(w.hash, w.first, n, t)
                        totals[n] += np.bincount(np.searchsorted(t, code), minlength=len(t))
        for n, total in totals.items():
            at = np.flatnonzero(total)
            if len(at):
                yield pa.record_batch([pa.array(np.full(len(at), n), pa.int32()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["n", "gram", "c"])

    # As many rows come back as the block has n-grams.
    counts = {n: np.zeros(len(t), np.int64) for n, t in tables.items()}
    if tables:
        for r in rows.select("text").mapInArrow(count, "n int, gram bigint, c bigint").groupBy("n", "gram").agg(F.sum("c").alias("c")).collect():
            counts[r["n"]][r["gram"]] = r["c"]
    items.choose({n: counts[n][np.searchsorted(tables[n], code)] for n, (code, _, _) in items.grams.items()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            raw, off = utf8(b.column(1))
            out = []
            for lo, hi in chunks(off):
                w = _words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for d, i, score, kept, first, end in _near(items, w):
                    out.append((ids[lo + d], items.ids[i], kept / len(items.codes[i]), score, first, end))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["row_id", "item_id", "similarity", "score", "first_word", "end_word"])

    return rows.mapInArrow(find, _OUT)
