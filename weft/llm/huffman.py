"""Canonical length-limited Huffman codes on numbers, with table-driven decoding of many blocks at once."""

from __future__ import annotations

import numpy as np


def lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of at most `limit` bits that give the fewest bits in all (package-merge); 0 where the count is 0.

    Symbols of equal count are taken in order, so the lengths depend on the counts only.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # One list a level: leaves merged with pairs of the level below; what matters later is which are leaves.
    row, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        row = both[place]
        levels.append(place < n)
    take = 2 * n - 2
    for leaf in reversed(levels):
        singles = int(leaf[:take].sum())
        out[order[:singles]] += 1
        take = 2 * (take - singles)
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """Canonical codes: in order of (length, symbol), each the one before plus 1, shifted where the length grows."""
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    out = np.zeros(len(length), np.uint64)
    if len(order):
        # Codes as left-aligned fractions: each symbol takes 2**(longest - length) of the range.
        longest = int(length.max())
        width = np.uint64(1) << (longest - length[order].astype(np.int64)).astype(np.uint64)
        left = np.cumsum(width) - width
        out[order] = left >> (longest - length[order].astype(np.int64)).astype(np.uint64)
    return out


class Packer:
    """Appends codes to a stream of big-endian 32-bit words; holds the bits of one unfinished word."""

    def __init__(self, length: np.ndarray) -> None:
        self.length, self.code = length.astype(np.int64), codes(length)
        self.bits, self._open = 0, 0

    def add(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Finished words, and the bit offset of each symbol in the stream."""
        size = self.length[symbols]
        if len(size) and not size.min():
            raise ValueError("a symbol has no code")
        start = self.bits % 32 + np.cumsum(size) - size
        end = int(start[-1] + size[-1]) if len(size) else self.bits % 32
        word = start >> 5
        value = self.code[symbols] << (64 - size - (start & 31)).astype(np.uint64)
        # Codes don't overlap, so adding them up sets bits; sums stay below 2**32, which doubles hold.
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), end // 32 + 2)
        words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), end // 32 + 2)[: len(words)]
        words[0] += self._open
        done = end // 32
        at = start + (self.bits - self.bits % 32)
        self.bits += end - self.bits % 32
        self._open = float(words[done])
        return words[:done].astype(">u4").tobytes(), at

    def finish(self) -> bytes:
        return np.array([self._open], ">u4").tobytes() if self.bits % 32 else b""


class Table:
    """Every string of as many bits as the longest code -> the symbol it begins with, and its length."""

    def __init__(self, length: np.ndarray) -> None:
        self.longest = int(length.max(initial=0)) or 1
        order = np.lexsort((np.arange(len(length)), length))
        order = order[length[order] > 0]
        width = 1 << (self.longest - length[order].astype(np.int64))
        self.entry = np.zeros(1 << self.longest, np.uint32)  # a length of 0: no code
        filled = np.repeat(order.astype(np.uint32) << np.uint32(8) | length[order], width)
        self.entry[: len(filled)] = filled

    def decode(self, data: bytes, first_bit: int, starts: np.ndarray, ends: np.ndarray, each: int, last: int) -> np.ndarray:
        """Symbols of adjacent blocks of `each` symbols (the final one of `last`), all blocks one symbol a step.

        data begins at bit first_bit of the stream (a multiple of 32); starts and ends are the blocks' bits in
        the stream. A block that doesn't end where the next begins is an error.
        """
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        at = starts.astype(np.int64) - first_bit
        out = np.empty((each, len(at)), np.uint32)
        stop = len(words) - 2
        mask, shift = np.uint64((1 << self.longest) - 1), 64 - self.longest
        finish = at.copy()
        for k in range(each):
            if k == last:
                finish[-1] = at[-1]
            word = np.minimum(at >> 5, stop)
            two = (words[word] << np.uint64(32)) | words[word + 1]
            got = self.entry[((two >> (shift - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)]
            out[k] = got >> np.uint32(8)
            at = at + (got & np.uint32(255))
        finish[:-1] = at[:-1]
        if last == each:
            finish[-1] = at[-1]
        if (finish + first_bit != ends).any():
            raise ValueError("a block of codes doesn't end at its checkpoint")
        return out.T.ravel()[: (len(at) - 1) * each + last]
