"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet ranks, sampled positions.

All queries are vectorised over many phrases or many rows at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (distinct or repeated non-negative integers) in order, by prefix doubling.

    Only positions whose rank is still shared are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = text[order][1:] != text[order][:-1]
    start = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))  # rank: first place of the group
    open_ = np.flatnonzero(np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n))))
    k = 1
    while len(open_):
        at = order[open_]
        then = at + k
        key = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        both = rank[at] * np.int64(n + 1) + key
        sort = np.argsort(both, kind="stable")
        at, both = at[sort], both[sort]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(open_[head], size)
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    return order


class Wavelet:
    """Ranks in a sequence over [0, 2**levels) by a wavelet matrix: a stable partition by each bit, highest first."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            total = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=total[1:])
            self.ones.append(total)
            self.zeros.append(len(symbols) - int(total[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``upto``."""
        low, high = np.zeros_like(upto), upto
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = (symbol >> (self.levels - 1 - i)) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``at``, and how often each is before its place."""
        symbol, low, here = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[here + 1] - ones[here]
            a, b = ones[low], ones[here]
            low, here = np.where(bit == 1, zeros + a, low - a), np.where(bit == 1, zeros + b, here - b)
            symbol = symbol * 2 + bit
        return symbol, here - low


class FMIndex:
    """Over ``text`` of symbols 1 .. ``sigma``; 0 is a separator that no phrase holds."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(np.asarray(text, np.int64), 0)  # ends with a separator
        gaps = np.flatnonzero(text == 0)
        apart = text + len(gaps)
        apart[gaps[:-1]] = np.arange(1, len(gaps))  # separators are all different, the last one least
        apart[gaps[-1]] = 0
        order = suffix_array(apart)
        before = text[order - 1]
        self.n, self.sample = len(text), sample
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.wavelet = Wavelet(before, max(1, int(sigma).bit_length()))
        kept = (order % sample == 0) | (before == 0)  # run starts too: no walk steps onto a separator
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last row for each phrase (a row of symbols, equally long), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column]
            low[alive] = self.count[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.count[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back, symbol by symbol, to a sampled position."""
        rows, steps, out = np.array(rows, np.int64), 0, np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.marked[here + 1] > self.marked[here]
            out[open_[done]] = self.positions[self.marked[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            symbol, rank = self.wavelet.access(here)
            rows[open_] = self.count[symbol] + rank
            steps += 1
        return out
