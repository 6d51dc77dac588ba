"""An FM-index over words in numpy: suffix sorting, a wavelet matrix with ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of an int array. 0 ends a segment; of two ends the earlier is the smaller.

    Prefix doubling from four symbols on; each round sorts only suffixes that are still tied.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max() + 1).bit_length())
    width = max(1, min(8, 63 // bits))
    # The key of the first symbols; nothing after a segment's end counts, as ends are distinct by position.
    key = np.zeros(n, np.uint64)
    live = np.ones(n, bool)
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    for k in range(width):
        part = padded[k : k + n]
        key = (key << np.uint64(bits)) | np.where(live, part, 0).astype(np.uint64)
        live &= part != 0
    # live: no end among the first symbols. Others with equal keys differ by position only.
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~live[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    size = width
    while True:
        # Groups of equal rank with more than one suffix.
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, n))
        at = np.flatnonzero(np.repeat(length > 1, length))
        if not len(at):
            return order
        rows = order[at]
        follow = np.minimum(rows + size, n - 1)
        second = np.where(rows + size < n, rank[follow] + 1, 0)
        first = rank[rows]
        again = np.lexsort((second, first))
        order[at] = rows[again]
        a, b = first[again], second[again]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        fresh[at] = new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        size *= 2


class WaveletMatrix:
    """rank(c, i): how often c stands among the first i values."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now, n = values, len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            before = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.words.append(packed)
            self.counts.append(before)
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros_like(i)
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, low), self._ones(k, i)
            low, i = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            one = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(k, i)
            out = out << 1 | one
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return out


class FMIndex:
    """Counts and locates patterns (without 0) in a text of segments that end with 0."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, symbols: int):
        self.n = len(text)
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.wavelet = WaveletMatrix(before.astype(np.int64), symbols)
        # Kept positions: every 16th, and the first of each segment, so that no walk goes over an end.
        kept = (order % self.SAMPLE == 0) | (before == 0)
        bits = np.flatnonzero(kept)
        self.kept, self.at = bits, order[bits]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the patterns, the rows of a matrix filled up at their ends."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(int(sizes.max(initial=0))):
            todo = np.flatnonzero((sizes > back) & (low < high))
            if not len(todo):
                break
            c = patterns[todo, sizes[todo] - 1 - back]
            low[todo] = self.first[c] + self.wavelet.rank(c, low[todo])
            high[todo] = self.first[c] + self.wavelet.rank(c, high[todo])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a kept one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, now = np.arange(len(rows)), rows.copy()
        while len(todo):
            slot = np.searchsorted(self.kept, now)
            hit = (slot < len(self.kept)) & (self.kept[np.minimum(slot, len(self.kept) - 1)] == now)
            out[todo[hit]] = self.at[slot[hit]] + steps[todo[hit]]
            todo, now = todo[~hit], now[~hit]
            if not len(todo):
                break
            c = self.wavelet.access(now)
            now = self.first[c] + self.wavelet.rank(c, now)
            steps[todo] += 1
        return out
