"""Compressed FM-index of many short sequences of numbers, searched for fixed-length patterns."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view("<u8")
        self._before = np.r_[0, np.cumsum(np.bitwise_count(self._words), dtype=np.int64)].astype(np.int32)

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._before[word] + np.bitwise_count(self._words[word] & low)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol, all nodes of a level side by side."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self._levels, self._bits = [], max(int(symbols - 1).bit_length(), 1)
        for bit in range(self._bits - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(np.uint8)
            self._levels.append((BitVector(ones), len(sequence) - int(ones.sum()), bit))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])
        self._origin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for vector, zeros, bit in self._levels:
            ones = vector.ones_before(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbol, at) - self._origin[symbol]


class Index:
    """FM-index of ``text`` (numbers from 1, sequences closed by 0) for patterns of exactly ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols, those alike by ``order``; the rows of a pattern are then one
    interval, and its first row is the occurrence with the smallest ``order``.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray, depth: int):
        self.depth = depth
        key, span = text, 1
        while span < depth:
            step = min(span, depth - span)
            later = np.zeros_like(key)
            later[:len(key) - step] = key[step:]
            # a suffix past a closing 0 goes on into the next sequence; only patterns without 0 are searched
            _, key = np.unique(key * np.int64(int(later.max(initial=0)) + 1) + later, return_inverse=True)
            span += step
        self._rows = np.lexsort((order, key))
        self.order = order[self._rows]
        symbols = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=symbols)
        self._less = np.cumsum(counts) - counts
        self._tree = WaveletTree(text[self._rows - 1], symbols)

    def matching(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of patterns (rows of ``depth`` symbols): (symbols matched from the end in at least two
        places, smallest ``order`` among the occurrences of the whole pattern or -1).

        Backward search of all patterns together; those left with a single place are dropped at once.
        """
        n = len(patterns)
        matched, least = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        alive, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self._rows), np.int64)
        for k in range(self.depth - 1, -1, -1):
            symbol = patterns[alive, k]
            low = self._less[symbol] + self._tree.rank(symbol, low)
            high = self._less[symbol] + self._tree.rank(symbol, high)
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
            matched[alive] += 1
        least[alive] = self.order[low]
        return matched, least
