"""FM-index over word identifiers: backward search through a wavelet matrix, sampled suffixes.

All operations take arrays of queries, so thousands of phrases go through the index together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence of non-negative integers, by prefix doubling.

    The first keys pack as many symbols as fit in 62 bits; later rounds sort only the suffixes
    that are still tied, so repeated documents cost a logarithmic number of small rounds.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max() + 1).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    active, sorted_key, at = order, key[order], np.arange(n)
    while True:
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = head + 1
        tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
        at, active = at[tied], active[tied]
        if not len(at):
            return order
        nxt = np.minimum(active + depth, n)
        combined = rank[active] * (n + 2) + rank[nxt]
        inner = np.argsort(combined, kind="stable")
        active, sorted_key = active[inner], combined[inner]
        order[at] = active
        depth *= 2


class Wavelet:
    """Rank of any symbol at any place of a sequence, in one pass per bit of the alphabet."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])
        self.begin = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[place]
            place = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + one, place - one)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, place) - self.begin[symbol]


class FMIndex:
    """Index of one text: integers below ``symbols``, 0 kept for the end mark it appends."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8) -> None:
        text = np.concatenate([text, [0]]).astype(np.int64)
        self.size = len(text)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols]
        self.wavelet = Wavelet(self.bwt, symbols)
        kept = order % sample == 0
        self.sampled = np.where(kept, order, -1).astype(np.int32)

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, place)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each phrase, a row of the matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive], high[alive] = self.step(symbol, low[alive]), self.step(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high) if len(phrases) else high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence, walking back to the next sampled suffix."""
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found, steps, open_ = np.full(len(row), -1, np.int64), 0, np.arange(len(row))
        while len(open_):
            there = self.sampled[row[open_]]
            done = there >= 0
            found[open_[done]] = there[done] + steps
            open_ = open_[~done]
            symbol = self.bwt[row[open_]]
            row[open_] = self.step(symbol, row[open_])
            steps += 1
        return phrase, found
