"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACES = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(SPACES, (text or "").translate(ASCII_LOWER))


def removed(rows: list[tuple], length: int = 100) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        kept = bytes(x for x, r in zip(raw, gone) if not r)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def components(rows: list[tuple], n: int, percent: int) -> dict:
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def fit_edits(item: list, passage: list) -> int:
    """Least edits that turn item into any run of passage."""
    row = [0] * (len(passage) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(passage, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[-1] + 1))
        row = new
    return min(row)


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, row[j - 1] + (x != y), new[-1] + 1))
        row = new
    return row[-1]


def local_score(a: list, b: list) -> int:
    """Smith-Waterman with match 2, mismatch and gap -1."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j] - 1, row[j - 1] + (2 if x == y else -1), new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def repeated_windows(rows: list[tuple], n: int = 50) -> set:
    """Ids of documents that share a run of n words with another one."""
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    return set().union(*(s for s in where.values() if len(s) > 1))


def normal(text: str | None) -> str:
    return " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(ASCII_LOWER))) + " "


def holds(docs: list[tuple], items: list[tuple]) -> set:
    """(document, item) where the item occurs word for word."""
    of = [(j, normal(t)) for j, t in items if normal(t).strip()]
    return {(i, j) for i, t in docs for j, x in of if x in normal(t)}
