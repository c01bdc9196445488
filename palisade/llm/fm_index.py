"""An FM-index over a sequence of symbols: counting and locating by backward search."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self._words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.ones = int(counts.sum())

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        low = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        word = at >> 6
        return self._before[word] + np.bitwise_count(self._words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE == _ONE


class _WaveletMatrix:
    """Symbols by their bits, highest first; zeros of a level go before ones."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self._levels: list[tuple[int, _Bits, int]] = []
        rest = symbols
        for shift in range(width - 1, -1, -1):
            bits = (rest >> shift & 1).astype(bool)
            level = _Bits(bits)
            self._levels.append((shift, level, len(bits) - level.ones))
            rest = np.concatenate((rest[~bits], rest[bits]))
        self._base = self._descend(np.arange(1 << width), np.zeros(1 << width, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self._levels:
            ones = level.ones_before(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbol, at) - self._base[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(at), np.int64)
        for shift, level, zeros in self._levels:
            one = level.get(at)
            ones = level.ones_before(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self._base[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; each 0 differs from all others, by place."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    reach = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-reach] = rank[reach:] + 1
        key = rank * np.int64(max(n, int(rank.max()) + 1) + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        reach *= 2


class FMIndex:
    """Index of runs of symbols 1..``largest``, each run followed by a 0.

    Patterns hold no 0, so they lie inside runs. Suffix positions are kept for
    every ``rate``-th place and for the first place of each run, so the walk to
    a kept position never crosses a 0.
    """

    def __init__(self, symbols: np.ndarray, largest: int, rate: int = 16) -> None:
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the sequence ends in 0, which precedes its start
        counts = np.bincount(symbols, minlength=largest + 1)
        self._first = np.concatenate(([0], np.cumsum(counts)))
        self._tree = _WaveletMatrix(before, max(1, int(largest).bit_length()))
        marked = (order % rate == 0) | (before == 0)
        self._marks = _Bits(marked)
        self._kept = order[marked]
        self._length = len(symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the patterns (all of one length) that occur, and their suffix intervals."""
        which = np.arange(len(patterns))
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self._length, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, column]
            low = self._first[symbol] + self._tree.rank(symbol, low)
            high = self._first[symbol] + self._tree.rank(symbol, high)
            found = high > low
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the intervals: number of its interval, and position."""
        count = high - low
        interval = np.repeat(np.arange(len(count)), count)
        row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        position = np.empty(len(row), np.int64)
        waiting, steps = np.arange(len(row)), 0
        while len(waiting):
            kept = self._marks.get(row)
            position[waiting[kept]] = self._kept[self._marks.ones_before(row[kept])] + steps
            waiting, row = waiting[~kept], row[~kept]
            symbol, rank = self._tree.symbol_and_rank(row)
            row = self._first[symbol] + rank
            steps += 1
        return interval, position
