"""A word-level FM-index with wavelet-tree ranks and sampled suffix positions (runs inside tasks)."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes. Symbol 0 ends a run: each 0 sorts below all words, and among zeros by place."""
    n = len(symbols)
    zeros = symbols == 0
    first = symbols.astype(np.int64) + int(zeros.sum())
    first[zeros] = np.arange(int(zeros.sum()))
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, dtype=np.int64)
    heads = np.flatnonzero(fresh)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    size = np.repeat(np.diff(np.r_[heads, n]), np.diff(np.r_[heads, n]))
    tied, depth = order[size > 1], 1
    while len(tied):
        # a tied suffix holds `depth` words, so another suffix follows it
        key = rank[tied] * n + rank[tied + depth]
        turn = np.argsort(key, kind="stable")
        tied, key = tied[turn], key[turn]
        group = rank[tied]
        old = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        of_old = np.repeat(old, np.diff(np.r_[old, len(tied)]))
        lengths = np.diff(np.r_[new, len(tied)])
        of_new = np.repeat(new, lengths)
        rank[tied] = group + of_new - of_old
        tied = tied[np.repeat(lengths, lengths) > 1]
        depth *= 2
    order[rank] = np.arange(n)
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level after the other."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        now = values
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[i]
            i = np.where((symbols >> (self.levels - 1 - level)) & 1, zeros + one, i - one)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        return self._down(symbols, i) - self.begin[symbols]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbols = np.zeros(len(i), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i]
            bit = ones[i + 1] - one
            symbols = (symbols << 1) | bit
            i = np.where(bit, zeros + one, i - one)
        return symbols, i - self.begin[symbols]


class FMIndex:
    """symbols: words from 1 to sigma - 1, and a 0 after each run. Patterns have no 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        suffixes = suffix_array(symbols)
        self.n = len(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        last = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        self.wavelet = WaveletMatrix(last, sigma)
        # each run's start is sampled, so that no walk crosses a 0
        self.sampled = (suffixes % sample == 0) | (last == 0)
        self.sample_row = np.cumsum(self.sampled) - 1
        self.positions = suffixes[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of a matrix of patterns: those that occur, and their ranges of suffixes."""
        alive = np.arange(len(patterns))
        symbols = patterns[:, -1]
        low, high = self.before[symbols], self.before[symbols + 1]
        for column in range(patterns.shape[1] - 2, -1, -1):
            ok = low < high
            alive, low, high = alive[ok], low[ok], high[ok]
            if not len(alive):
                break
            symbols = patterns[alive, column]
            low = self.before[symbols] + self.wavelet.rank(symbols, low)
            high = self.before[symbols] + self.wavelet.rank(symbols, high)
        ok = low < high
        return alive[ok], low[ok], high[ok]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range index, place) of each occurrence."""
        counts = high - low
        which = np.repeat(np.arange(len(low)), counts)
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        places = np.empty(len(rows), dtype=np.int64)
        waiting, steps = np.arange(len(rows)), 0
        while len(waiting):
            hit = self.sampled[rows]
            places[waiting[hit]] = self.positions[self.sample_row[rows[hit]]] + steps
            waiting, rows = waiting[~hit], rows[~hit]
            symbols, rank = self.wavelet.access_rank(rows)
            rows = self.before[symbols] + rank
            steps += 1
        return which, places
