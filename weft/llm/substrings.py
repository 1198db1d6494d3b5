"""Suffix-array deduplication: remove each byte of a string of `length` bytes that occurs earlier in the corpus.

Sorting every suffix of a corpus moves many times its size, so only suffixes that can matter are sorted. Each
window of `length` bytes has an anchor, the leftmost of its k-grams with the least hash: equal windows have
equal anchors at the same place, and neighbouring windows mostly share one. That leaves a sparse suffix
array of about two anchors a window length, and anchors whose k-gram occurs once are left out of it too.

1. Count anchors' k-grams: one row of a few bytes an anchor is shuffled.
2. Documents, dealt to buckets, look up which of their anchors repeat, and send these with the bytes of the
   windows that they stand for (an anchor's context).
3. Suffixes that begin at anchors with one k-gram are sorted forwards and, reversed, backwards: multikey
   quicksort (eight bytes at a time, for all groups at once) to a shallow depth, then blind tries for the groups
   whose common prefix is longer. Two windows at one offset from their anchors are equal when the common
   prefixes on both sides are long enough, so the two orders and their LCPs tell each window's class,
   and the earliest of each class is a survivor.
4. Documents drop their repeated windows that aren't survivors.

A k-gram with more than HOT anchors (a passage or line in a large share of all documents) would fill one
task: its windows are grouped by 128-bit fingerprints instead, with a minimum computed map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import delete, materialize, release, scratch, tune
from weft.llm.textnum import mix64, utf8

LENGTH = 100
GRAM = 32
HOT = 1024
#: Bytes of text a bucket holds about, and starts of windows worked on at once.
BUCKET_BYTES = 24 << 20
SEGMENT = 1 << 21
#: Bytes before and, behind the k-gram, after an anchor that quicksort compares; tries take what is equal so far.
SHALLOW = 24
_U = np.uint64
_AT_BITS = 24  # position in a segment, below the hash bits that choose anchors
_RANDOM = np.random.default_rng(20240607)
_TABLES = [_RANDOM.integers(1, 1 << 64, 256, np.uint64) for _ in range(3)]
_BASES = [0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D]


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all runs of `size` (a power of two) bytes, by doubling."""
    h, k, base = _TABLES[0][raw], 1, _BASES[0]
    while k < size:
        h = h[:-k] * _U(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    return mix64(h)


def anchors(h: np.ndarray, windows: int) -> np.ndarray:
    """For each start of a window: where the leftmost least of the `windows` k-grams from there on is."""
    x = (h >> _U(_AT_BITS) << _U(_AT_BITS)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= windows:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    if k < windows:
        x = np.minimum(x[: len(x) - (windows - k)], x[windows - k :])
    return (x & _U((1 << _AT_BITS) - 1)).astype(np.int64)


class Segment:
    """Windows that start in a range of a batch's bytes, as runs of starts with one anchor.

    at, lo, hi: the anchor and the first and last start of each run, in the segment; doc: its document.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, first: int, last: int, length: int, gram: int) -> None:
        """Starts from first up to last (exclusive)."""
        self.raw, self.base = raw[first : last + length - 1], first
        empty = np.zeros(0, np.int64)
        self.at = self.lo = self.hi = self.doc = empty
        self.h = np.zeros(0, np.uint64)
        if len(self.raw) < length:
            return
        self.h = gram_hashes(self.raw, gram)
        c = anchors(self.h, length - gram + 1)
        # A start counts if its window lies in one document.
        d0, d1 = np.searchsorted(off, first, "right") - 1, np.searchsorted(off, first + len(c), "left")
        good = np.zeros(len(c) + 1, np.int8)
        begins, ends = np.maximum(off[d0:d1], first) - first, np.minimum(off[d0 + 1 : d1 + 1] - length + 1, first + len(c)) - first
        full = ends > begins
        np.add.at(good, begins[full], 1)
        np.add.at(good, ends[full], -1)
        good = np.cumsum(good[:-1]) > 0
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | ~good[:-1]
        new[begins[full]] = True
        lo = np.flatnonzero(new & good)
        stop = np.flatnonzero(np.r_[new[1:] | ~good[1:], True] & good)
        self.lo, self.hi, self.at = lo, stop, c[lo]
        self.doc = np.searchsorted(off, lo + first, "right") - 1


def segments(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> Iterator[Segment]:
    for first in range(0, max(len(raw) - length + 1, 0), SEGMENT):
        yield Segment(raw, off, first, min(first + SEGMENT, len(raw) - length + 1), length, gram)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


# ---- sorting -----------------------------------------------------------------------------------------------


class BlindTrie:
    """A Patricia trie over byte strings with a common prefix; keeps only branching depths and one byte each.

    Insertion goes down blindly to some leaf, compares the string with that leaf only, and branches where they
    part. A leaf is [ids] of equal strings; a node is (depth, {byte: child}), -1 as byte for a string's end.
    """

    def __init__(self) -> None:
        self.root: list | tuple | None = None

    def insert(self, text: bytes, ident: int, strings: list[bytes]) -> None:
        if self.root is None:
            self.root = [ident]
            return
        node = self.root
        while type(node) is tuple:
            depth, children = node
            node = children.get(text[depth] if depth < len(text) else -1)
            if node is None:
                node = next(iter(children.values()))
                while type(node) is tuple:
                    node = next(iter(node[1].values()))
        other = strings[node[0]]
        if other == text:
            node.append(ident)
            return
        same = common_prefix(text, other)
        mine, theirs = (t[same] if same < len(t) else -1 for t in (text, other))
        parent, node = None, self.root
        while type(node) is tuple and node[0] < same:
            parent = node
            node = node[1][text[node[0]] if node[0] < len(text) else -1]
        if type(node) is tuple and node[0] == same:
            node[1][mine] = [ident]
            return
        branch = (same, {theirs: node, mine: [ident]})
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = branch

    def order(self, whole: list[int]) -> tuple[list[int], list[int]]:
        """Ids in order and the common prefix of each with the one before (the first: -1); whole: lengths."""
        ids, lcp = [], []
        stack: list = [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if type(node) is tuple:
                depth, children = node
                keys = sorted(children)
                stack += [(children[k], depth) for k in keys[:0:-1]]
                stack.append((children[keys[0]], shared))
            else:
                ids += node
                lcp.append(shared)
                lcp += [whole[node[0]]] * (len(node) - 1)
        return ids, lcp


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def sort_strings(group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings data[start : start + size] within their group, and LCP of each with the one before it.

    group: ascending; a group's first string has LCP -1. Multikey quicksort takes eight bytes as a character,
    for all groups at once, down to `shallow` bytes; a blind trie orders each class that is equal so far.
    """
    n = len(group)
    order, lcp = np.arange(n), np.full(n, -1, np.int64)
    klass = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if n else np.zeros(0, np.int64)
    heads = np.flatnonzero(np.r_[True, klass[1:] != klass[:-1]]) if n else np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    active = np.arange(n)  # places in the order whose class has more than one string
    for depth in range(0, shallow, 8):
        counts = np.bincount(klass[active]) if len(active) else np.zeros(0, int)
        active = active[counts[klass[active]] > 1] if len(active) else active
        if not len(active):
            break
        row = order[active]
        left = np.clip(size[row] - depth, 0, 8)
        cell = padded[(start[row] + np.minimum(depth, size[row]))[:, None] + np.arange(8)]
        cell[np.arange(8)[None, :] >= left[:, None]] = 0
        key = cell.view(">u8").reshape(-1).astype(np.uint64)
        place = np.lexsort((left, key, klass[active]))
        row, key, left, of = row[place], key[place], left[place], klass[active][place]
        order[active] = row
        differ = np.flatnonzero((key[1:] != key[:-1]) | (left[1:] != left[:-1]))
        differ = differ[of[differ] == of[differ + 1]]
        both = key[differ] ^ key[differ + 1]
        zeros = np.zeros(len(both), np.int64)
        for bits in (32, 16, 8):  # leading zero bytes
            step = (both >> _U(64 - bits)) == 0
            zeros[step] += bits // 8
            both = np.where(step, both << _U(bits), both)
        zeros = np.minimum(np.where(key[differ] == key[differ + 1], 8, zeros), np.minimum(left[differ], left[differ + 1]))
        lcp[active[differ + 1]] = depth + zeros
        fresh = np.zeros(n, bool)
        fresh[active[differ + 1]] = True
        starts = np.zeros(n, bool)
        starts[heads] = True
        heads = np.flatnonzero(starts | fresh)
        klass = np.cumsum(starts | fresh) - 1
    bounds = np.r_[heads, n]
    for g in np.flatnonzero(np.diff(bounds) > 1):
        a, b = bounds[g], bounds[g + 1]
        rows = order[a:b]
        strings = [data[start[r] : start[r] + size[r]].tobytes() for r in rows]
        trie = BlindTrie()
        for k, text in enumerate(strings):
            trie.insert(text, k, strings)
        ids, shared = trie.order([len(s) for s in strings])
        order[a:b] = rows[ids]
        lcp[a + 1 : b] = shared[1:]
    return order, lcp


def survivors(group: np.ndarray, data: np.ndarray, start: np.ndarray, o_lo: np.ndarray, o_hi: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are the earliest of their class, as (row, least offset, largest offset) of the anchor in them.

    A row's bytes begin at start with the window of offset o_hi, and end with that of offset o_lo.
    """
    n = len(group)
    o_lo, o_hi = o_lo.astype(np.int64), o_hi.astype(np.int64)
    place_r, lcp_r = sort_strings(group, data, start + o_hi, length - o_lo, GRAM + SHALLOW)
    # Left contexts are read backwards: a mirrored copy of the bytes, with the anchor's k-gram left out.
    mirrored = data[::-1]
    place_l, lcp_l = sort_strings(group, mirrored, len(data) - (start + o_hi), o_hi)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, doc))] = np.arange(n)
    owner = np.zeros((n, int(o_hi.max()) + 2 if n else 1), bool)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    by_rank = np.argsort(rank)
    for o in range(int(o_lo.min()) if n else 0, int(o_hi.max()) + 1 if n else 0):
        right[place_r] = np.cumsum(lcp_r < length - o)
        left[place_l] = np.cumsum(lcp_l < o)
        rows = by_rank[(o_lo[by_rank] <= o) & (o <= o_hi[by_rank])]
        key = right[rows] * (n + 1) + left[rows]
        sort = np.argsort(key, kind="stable")
        first = np.r_[True, key[sort][1:] != key[sort][:-1]] if len(rows) else np.zeros(0, bool)
        owner[rows[sort[first]], o] = True
    edge = np.diff(np.pad(owner.astype(np.int8), ((0, 0), (1, 0))), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return row, lo, hi - 1


# ---- steps -------------------------------------------------------------------------------------------------


def _counted(length: int, gram: int):  # noqa: ANN202
    schema = pa.schema([("h", pa.int64()), ("bucket", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            raw, off = utf8(b.column("text"))
            code, of = [], []
            for s in segments(raw, off, length, gram):
                code.append(s.h[s.at])
                of.append(bucket[s.doc])
            if not code:
                continue
            code, of = np.concatenate(code), np.concatenate(of)
            order = np.lexsort((of, code))
            code, of = code[order], of[order]
            at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])]) if len(code) else np.zeros(0, int)
            yield pa.record_batch([pa.array(code[at].view(np.int64)), pa.array(of[at], pa.int32()), pa.array(np.diff(np.r_[at, len(code)]), pa.int64())], schema=schema)

    return run


def _repeated(hot: int):  # noqa: ANN202
    schema = pa.schema([("bucket", pa.int32()), ("cold", pa.binary()), ("hot", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        h, bucket, c = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, bucket, c = h[order], bucket[order], c[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.repeat(np.add.reduceat(c, at), np.diff(np.r_[at, len(h)]))
        h, bucket, is_hot = h[total > 1], bucket[total > 1], total[total > 1] > hot
        order = np.lexsort((h, bucket))
        h, bucket, is_hot = h[order], bucket[order], is_hot[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])] if len(h) else np.zeros(0, bool)
        h, bucket, is_hot = h[new], bucket[new], is_hot[new]
        for k in np.unique(bucket):
            a, b = np.searchsorted(bucket, k, "left"), np.searchsorted(bucket, k, "right")
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([h[a:b][~is_hot[a:b]].tobytes()], pa.binary()), pa.array([h[a:b][is_hot[a:b]].tobytes()], pa.binary())], schema=schema)

    return run


_CONTEXT = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("k", pa.int64()), ("context", pa.binary()), ("o_lo", pa.int32()), ("o_hi", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary())]
)
_CONTEXT_SQL = "kind int, bucket int, h bigint, k bigint, context binary, o_lo int, o_hi int, doc_id bigint, at bigint, lo binary, hi binary"


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in _CONTEXT], schema=_CONTEXT)


def _member(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _contexts(length: int, gram: int):  # noqa: ANN202
    """Rows of a bucket, its repeated k-grams first, then documents -> contexts (kind 0), windows of hot k-grams
    (kind 1) and the starts of all repeated windows of each document (kind 2)."""

    def documents(bucket: int, cold: np.ndarray, hot: np.ndarray, ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []
        for s in segments(raw, off, length, gram):
            h = s.h[s.at].view(np.int64)
            is_cold, is_hot = _member(cold, h), _member(hot, h)
            at_doc = s.base - off[s.doc]  # from segment to document
            any_ = is_cold | is_hot
            whole.append((s.doc[any_], (s.lo + at_doc)[any_], (s.hi + at_doc)[any_]))
            if is_cold.any():
                lo, hi, at, doc = s.lo[is_cold], s.hi[is_cold], s.at[is_cold], s.doc[is_cold]
                size = hi - lo + length
                n, body = len(lo), s.raw[ranges(lo, size)]
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                context = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
                yield _rows(n, kind=pa.array(np.zeros(n, np.int32)), h=pa.array(h[is_cold]), context=context, o_lo=pa.array((at - hi).astype(np.int32)), o_hi=pa.array((at - lo).astype(np.int32)), doc_id=pa.array(ids[doc]), at=pa.array(at + at_doc[is_cold]))
            if is_hot.any():
                lo, hi = s.lo[is_hot], s.hi[is_hot]
                starts = ranges(lo, hi - lo + 1)
                doc = np.repeat(s.doc[is_hot], hi - lo + 1)
                one, two = (_window_hash(s.raw, starts, length, k).view(np.int64) for k in (1, 2))
                where = starts + s.base - off[doc]
                order = np.lexsort((where, ids[doc], two, one))
                one, two, where, doc = one[order], two[order], where[order], doc[order]
                at = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                yield _rows(len(at), kind=pa.array(np.ones(len(at), np.int32)), h=pa.array(one[at]), k=pa.array(two[at]), doc_id=pa.array(ids[doc[at]]), at=pa.array(where[at]))
        if whole:
            doc, lo, hi = (np.concatenate(x) for x in zip(*whole))
            if len(doc):
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                last = np.r_[first[1:], len(doc)]
                n = len(first)
                yield _rows(n, kind=pa.array(np.full(n, 2, np.int32)), bucket=pa.array(np.full(n, bucket, np.int32)), doc_id=pa.array(ids[doc[first]]), lo=pa.array([lo[a:b].tobytes() for a, b in zip(first, last)]), hi=pa.array([hi[a:b].tobytes() for a, b in zip(first, last)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cold, hot, ready = None, [], [], False
        for b in batches:
            bucket, is_doc = b.column("bucket").to_numpy(), b.column("is_doc").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (is_doc[1:] != is_doc[:-1])]) if len(bucket) else []
            for a, z in zip(edge, np.r_[edge[1:], len(bucket)] if len(bucket) else []):
                part = b.slice(a, z - a)
                if bucket[a] != current:
                    current, cold, hot, ready = bucket[a], [], [], False
                if not is_doc[a]:
                    cold += [np.frombuffer(x, np.int64) for x in part.column("cold").to_pylist()]
                    hot += [np.frombuffer(x, np.int64) for x in part.column("hot").to_pylist()]
                    continue
                if not ready:
                    cold, hot, ready = [np.sort(np.concatenate(cold or [np.zeros(0, np.int64)]))], [np.sort(np.concatenate(hot or [np.zeros(0, np.int64)]))], True
                raw, off = utf8(part.column("text"))
                yield from documents(int(current), cold[0], hot[0], part.column("doc_id").to_numpy(), raw, off)

    return run


def _window_hash(raw: np.ndarray, starts: np.ndarray, length: int, k: int) -> np.ndarray:
    """Fingerprints of windows, by doubling over the whole segment; k picks the hash function."""
    h, size, base = _TABLES[k][raw], 1, _BASES[k]
    out, done = None, 0
    while size <= length:
        if length & size:
            part = h[starts + done]
            out = part if out is None else out * _U(pow(base, size, 1 << 64)) + part
            done += size
        if 2 * size > length:
            break
        h = h[:-size] * _U(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    return mix64(out)


def _groups(length: int):  # noqa: ANN202
    """Contexts sorted by k-gram -> surviving starts (doc_id, lo, hi); works on whole groups, some at once."""
    schema = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        data, start = utf8(t.column("context"))
        h, o_lo, o_hi, doc, at = (t.column(c).to_numpy() for c in ("h", "o_lo", "o_hi", "doc_id", "at"))
        row, lo, hi = survivors(h, data, start[:-1], o_lo, o_hi, doc, at, length)
        return pa.record_batch([pa.array(doc[row]), pa.array(at[row] - hi), pa.array(at[row] - lo)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on
            if held and h[0] != held[-1].column("h")[-1].as_py() and rows >= 20_000:
                yield work(pa.Table.from_batches(held))
                held, rows = [], 0
            if cut and rows + cut >= 20_000:
                held.append(b.slice(0, cut))
                yield work(pa.Table.from_batches(held))
                held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def removed_bytes(size: int, lo: np.ndarray, hi: np.ndarray, kept_lo: np.ndarray, kept_hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (begin, end) from the starts of repeated windows and those of survivors."""
    change = np.zeros(size + 2, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    repeated = np.cumsum(change[:-1]) > 0
    change[:] = 0
    np.add.at(change, kept_lo, 1)
    np.add.at(change, kept_hi + 1, -1)
    repeated &= ~(np.cumsum(change[:-1]) > 0)
    edge = np.flatnonzero(np.diff(np.r_[False, repeated, False]))
    begin, end = edge[::2], edge[1::2] - 1 + length
    if not len(begin):
        return begin, end
    apart = np.r_[True, begin[1:] > end[:-1]]
    return begin[apart], end[np.r_[apart[1:], True]]


def _cut(length: int):  # noqa: ANN202
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, starts, kept = None, [], []
        for b in batches:
            out = []
            for doc, kind, lo, hi, text in zip(*(b.column(c).to_pylist() if c != "text" else b.column(c) for c in ("doc_id", "kind", "lo", "hi", "text"))):
                if doc != current:
                    current, starts, kept = doc, [], []
                if kind < 2:
                    (kept if kind == 0 else starts).append((np.frombuffer(lo, np.int64), np.frombuffer(hi, np.int64)))
                    continue
                raw = memoryview(text.as_buffer() if text.is_valid else b"")
                begin = end = np.zeros(0, np.int64)
                if starts:
                    a, z = (np.concatenate(x) for x in zip(*starts))
                    ka, kz = (np.concatenate(x) for x in zip(*kept)) if kept else (begin, end)
                    inside = z < len(raw)  # rows that share an id may differ in length
                    kin = kz < len(raw)
                    begin, end = removed_bytes(len(raw), a[inside], z[inside], ka[kin], kz[kin], length)
                    fit = end <= len(raw)
                    begin, end = begin[fit], end[fit]
                digest, last = hashlib.sha256(), 0
                for x, y in zip(begin.tolist(), end.tolist()):
                    digest.update(raw[last:x])
                    last = y
                digest.update(raw[last:])
                out.append((doc, len(raw), int((end - begin).sum()), len(begin), digest.hexdigest(), np.stack([begin, end], 1).reshape(-1).tolist()))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Return one row per input row: row_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a string of `length` bytes over it also starts earlier: in a document of smaller id, or
    earlier in the same one; overlaps count, documents are judged as they came in. spans: begin and end of each
    maximal removed run, flat. Null texts count as empty, shorter ones than `length` stay whole. Rows that
    repeat an id count as one document (a start that stays in one of them stays in all); rows without id are
    one document before all others. Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(row_id).cast("bigint").alias("given"), F.col(text).cast("binary").alias("text")).withColumn("doc_id", F.coalesce("given", F.lit(-(1 << 63))))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)

    counted = dealt.select("bucket", "text").mapInArrow(_counted(length, gram), "h bigint, bucket int, c bigint").repartition(parts, "h")
    repeated = materialize(counted.mapInArrow(_repeated(hot), "bucket int, cold binary, hot binary"), "repeated")

    looked_up = repeated.select("bucket", F.lit(False).alias("is_doc"), "cold", "hot", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("text"))
    as_docs = dealt.select("bucket", F.lit(True).alias("is_doc"), F.lit(None).cast("binary").alias("cold"), F.lit(None).cast("binary").alias("hot"), "doc_id", "text")
    together = looked_up.unionByName(as_docs).repartition(parts, "bucket").sortWithinPartitions("bucket", "is_doc")
    path = scratch(spark, "contexts")
    together.mapInArrow(_contexts(length, gram), _CONTEXT_SQL).write.partitionBy("kind").parquet(path)
    release(spark, repeated)
    found = spark.read.schema(_CONTEXT_SQL).parquet(path)

    cold = found.where("kind = 0").select("h", "context", "o_lo", "o_hi", "doc_id", "at").repartition(parts, "h").sortWithinPartitions("h")
    sorted_out = cold.mapInArrow(_groups(length), "doc_id bigint, lo bigint, hi bigint")
    windows = found.where("kind = 1").groupBy("h", "k").agg(F.min(F.struct("doc_id", "at")).alias("m")).select("m.doc_id", F.col("m.at").alias("lo"), F.col("m.at").alias("hi"))
    kept = materialize(sorted_out.unionByName(windows), "survivors")
    for kind in (0, 1):
        delete(spark, f"{path}/kind={kind}")
    release(spark)
    found = spark.read.schema(_CONTEXT_SQL).parquet(path)

    pack = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    little = lambda c: F.concat(*[F.substring(pack(c), k, 1) for k in range(8, 0, -1)])  # noqa: E731 - as NumPy reads it
    nothing = F.lit(None).cast("binary")
    survived = kept.select("doc_id", F.lit(0).alias("kind"), little(F.col("lo")).alias("lo"), little(F.col("hi")).alias("hi"), nothing.alias("text"))
    starts = found.where("kind = 2").select("doc_id", F.lit(1).alias("kind"), "lo", "hi", nothing.alias("text"))
    whole = rows.select("doc_id", F.lit(2).alias("kind"), nothing.alias("lo"), nothing.alias("hi"), "text")
    back = survived.unionByName(starts).unionByName(whole).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind")
    out = back.mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
    return out.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias(row_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
