"""Vectorised hashes of words and of word sequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BLOCK = 1 << 20  # bytes hashed at once
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def _powers_to(base: int, bits: int) -> np.ndarray:
    powers = np.full(1 << bits, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _powers(base: int, n: int) -> np.ndarray:
    return _powers_to(base, max(12, int(n).bit_length()))[: n + 1]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    if not data:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    inside = np.concatenate(([False], ~_SPACES[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; blocks of whole words bound the memory."""
    out = np.empty(len(starts), dtype=np.uint64)
    codes = np.frombuffer(data, np.uint8)
    begin = 0
    while begin < len(starts):
        low = starts[begin]
        end = max(begin + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
        part = codes[low:ends[end - 1]].astype(np.uint64) + np.uint64(1)
        n = len(part)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(part * _powers(_BASES[0], n)[:n], out=total[1:])
        a, b = starts[begin:end] - low, ends[begin:end] - low
        value = (total[b] - total[a]) * _powers(_INVERSES[0], n)[a]
        out[begin:end] = mix(value + (b - a).astype(np.uint64) * np.uint64(_BASES[1]))
        begin = end
    return out


def window_hashes(words: np.ndarray, lengths: np.ndarray | int, starts: np.ndarray | None = None,
                  lane: int = 1) -> np.ndarray:
    """Hash of the word sequences that begin at ``starts`` with ``lengths`` words.

    Without ``starts``, of all sequences of one length. Other lanes give other
    hashes of the same words.
    """
    n = len(words)
    if starts is None:
        starts = np.arange(max(0, n - int(lengths) + 1))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _powers(_BASES[lane], n)[:n], out=total[1:])
    value = (total[starts + lengths] - total[starts]) * _powers(_INVERSES[lane], n)[starts]
    return mix(value + np.uint64(lane))


def sliding_minimum(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each window of ``width`` values and its rightmost position."""
    best, at = values, np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:-step], best[step:]
        take = right <= left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        reach += step
    return best, at
