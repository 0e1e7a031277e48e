"""An FM-index over sequences of words: a Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FmIndex:
    """Symbols are 1 and up; 0 ends each sequence. Suffixes are ordered by their first `depth` symbols: enough for patterns up to that length."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        n = len(symbols)
        rank, reach = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        while reach < depth:  # order by 2 * reach symbols, or by depth if that is less
            step = min(reach, depth - reach)
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            reach += step
        self.suffixes = np.argsort(rank, kind="stable")
        last = symbols[self.suffixes - 1]
        sigma = int(symbols.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels: list[tuple[int, Bits, int]] = []
        start = np.zeros(sigma, dtype=np.int64)
        every = np.arange(sigma)
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift) & 1
            bits, zeros = Bits(bit.astype(bool)), int(n - bit.sum())
            self.levels.append((shift, bits, zeros))
            ones = bits.ones(start)
            start = np.where((every >> shift) & 1, zeros + ones, start - ones)
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.offset = self.first[:-1] - start

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Border of the interval of symbol + pattern from a border of the pattern's."""
        i = at
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i + self.offset[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns (rows): borders of each one's suffix interval, and how many of its last symbols were matched.

        It ends early for a pattern whose interval is down to one suffix, or to none: more symbols can't widen it.
        """
        n, m = patterns.shape
        low, high = self.first[patterns[:, -1]].copy(), self.first[patterns[:, -1] + 1].copy()
        matched = np.ones(n, dtype=np.int64)
        live = np.flatnonzero(high - low > 1)
        for k in range(m - 2, -1, -1):
            if not len(live):
                break
            c = patterns[live, k]
            both = self.step(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = both[: len(live)], both[len(live) :]
            matched[live] += 1
            live = live[high[live] - low[live] > 1]
        return low, high, matched
