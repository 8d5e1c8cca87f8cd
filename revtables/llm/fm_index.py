"""A full-text index of one shard of symbols: suffix positions, wavelet ranks, search.

The shard is a row of numbered runs of symbols. Rows of the index are the suffixes in
order; ``last`` holds the symbol before each. Phrases are searched from their last symbol
to their first, all at once; positions come from sampled suffixes and steps backward.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by ranks of stretches that double in length."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        if length < n:
            after[:-length] = rank[length:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, length = new, 2 * length


class WaveletRanks:
    """How often a symbol stands before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.symbols = symbols
        self.levels = []
        self.bits = max(1, int(kinds - 1).bit_length())
        now = symbols
        for level in reversed(range(self.bits)):
            bit = (now >> level) & 1
            ones = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(now) - int(ones[-1])))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for level, ones, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FmIndex:
    """Index of runs of symbols from 1 to ``kinds``, each ended by a mark no phrase has."""

    def __init__(self, runs: np.ndarray, starts: np.ndarray, kinds: int) -> None:
        """``runs``: the symbols of all runs with a 0 after each; ``starts``: where each begins."""
        marks = np.flatnonzero(runs == 0)
        distinct = runs.astype(np.int64) + len(marks)
        distinct[marks] = np.arange(len(marks))
        order = suffix_order(distinct)
        before = runs[order - 1]
        before[order == 0] = 0
        self.ranks = WaveletRanks(before.astype(np.int64), kinds + 1)
        totals = np.bincount(runs, minlength=kinds + 2)
        self.first = np.concatenate([[0], np.cumsum(totals)])
        sampled = order % SAMPLE == 0
        sampled[np.isin(order, starts)] = True
        self.sample = np.where(sampled, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each phrase; ``phrases`` has one per line, all of one length."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sample), np.int64)
        live = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[live, column]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffix of each row begins: steps backward until one is sampled."""
        steps = np.zeros(len(rows), np.int64)
        rows, found = rows.copy(), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = self.sample[rows[live]]
            hit = at >= 0
            found[live[hit]] = at[hit] + steps[live[hit]]
            live = live[~hit]
            symbol = self.ranks.symbols[rows[live]]
            rows[live] = self.first[symbol] + self.ranks.rank(symbol, rows[live])
            steps[live] += 1
        return found
