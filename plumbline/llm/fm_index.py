"""A compressed full-text index of number sequences: backward search over a wavelet matrix, for many patterns at once.

The texts, each followed by the separator 0, are sorted by their suffixes' first symbols (at least as many as a match
may have: a search up to that length never tells suffixes apart that agree in them). What stands before each suffix,
the Burrows-Wheeler transform, is kept as a wavelet matrix: one row of packed bits for each bit of a symbol with the
number of set bits before each word. A step of a search (put a symbol before the pattern) takes two ranks; all patterns
take their steps together in numpy.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np


class WaveletMatrix:
    """rank of symbols in a sequence of numbers."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(sequence)
        for level in range(self.levels):
            bit = (sequence >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            one = bit.astype(bool)
            self.zeros.append(n - int(np.count_nonzero(one)))
            sequence = np.concatenate([sequence[~one], sequence[one]])
        # where each symbol's run starts in the last order
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            words, before = self.words[level], self.before[level]
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place beside it."""
        return self._walk(symbol, at) - self.start[symbol]


class FmIndex:
    """Index of texts for matching statistics of up to depth symbols."""

    def __init__(self, texts: np.ndarray, ends: np.ndarray, owner: np.ndarray, depth: int):
        """texts: all texts in a row, symbols from 1 on; ends: where each one ends; owner: a number for each text."""
        lengths = np.diff(ends, prepend=0)
        text = np.zeros(len(texts) + len(ends), np.int64)
        text[np.arange(len(texts)) + np.repeat(np.arange(len(ends)), lengths)] = texts
        self.depth, self.n, self.symbols = depth, len(text), int(text.max(initial=0)) + 1
        order, self.common = self._sorted(text)
        self.bwt = WaveletMatrix(text[order - 1], self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        # suffixes that agree in depth symbols, and in one less, stand together
        self._low, self._high = self._groups(depth - 1)
        starts = np.flatnonzero(self.common < depth)
        least = np.minimum.reduceat(np.repeat(owner, lengths + 1)[order], starts) if self.n else owner
        self._least = np.repeat(least, np.diff(starts, append=self.n))

    def _sorted(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of suffixes by their first symbols, by doubling; and how many of these each has in common with the one before it."""
        n, rank, span, ranks = len(text), text, 1, [text]
        while span < self.depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - span)] = rank[span:] + 1
            rank = np.unique(rank * (n + self.symbols + 1) + after, return_inverse=True)[1]
            span *= 2
            ranks.append(rank)
        order = np.argsort(rank, kind="stable")
        one, two, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(one, two) < n
            same = np.zeros(len(one), bool)
            same[inside] = ranks[k][one[inside]] == ranks[k][two[inside]]
            for x in (one, two, common):
                x[same] += 1 << k
        return order, np.concatenate([[0], np.minimum(common, self.depth)])[:n].astype(np.int32)

    def _groups(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that agree with each one in so many symbols begin and end."""
        starts = np.flatnonzero(self.common < max(1, depth))
        sizes = np.diff(starts, append=self.n)
        return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

    @cached_property
    def _minima(self) -> list[np.ndarray]:
        """Least of common over the next 1, 2, 4, ... places."""
        out, span = [self.common.astype(np.uint8 if self.depth < 256 else np.int32)], 1
        while 2 * span <= self.n:
            out.append(np.minimum(out[-1][:-span], out[-1][span:]))
            span *= 2
        return out

    def _shortened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest intervals that hold more than these: their patterns lack some last symbols. (low, high, length)"""
        length = np.maximum(self.common[low], np.where(high < self.n, self.common[np.minimum(high, self.n - 1)], 0))
        low, high = low.copy(), high.copy()
        for k in range(len(self._minima) - 1, -1, -1):
            least, span = self._minima[k], 1 << k
            at = low - span + 1
            low = np.where((at >= 0) & (least[np.clip(at, 0, len(least) - 1)] >= length), low - span, low)
            high = np.where((high + span <= self.n) & (least[np.minimum(high, len(least) - 1)] >= length), high + span, high)
        root = length == 0
        return np.where(root, 0, low), np.where(root, self.n, high), length

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with a symbol and go on with one of those in [low, high)."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def statistics(self, patterns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each pattern: the length, up to depth, of the longest match that starts there, and the first of its suffixes.

        All patterns are read from their ends at once. What cannot be put before a match is put before a shorter one.
        """
        length, where = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        sizes = np.diff(ends, prepend=0)
        longest = np.argsort(-sizes, kind="stable")
        stop, sizes = ends[longest], sizes[longest]
        low, high, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64), np.zeros(len(sizes), np.int64)
        for back in range(1, int(sizes.max(initial=0)) + 1):
            k = int(np.searchsorted(-sizes, -back, side="right"))
            at = stop[:k] - back
            symbol = patterns[at]
            low, high, size = low[:k], high[:k], size[:k]
            full = np.flatnonzero(size == self.depth)
            low[full], high[full], size[full] = self._low[low[full]], self._high[low[full]], self.depth - 1
            if self.depth == 1:
                low[full], high[full] = 0, self.n
            strange = (symbol < 1) | (symbol >= self.symbols)
            strange |= self.first[np.where(strange, 0, symbol)] == self.first[np.where(strange, 0, symbol) + 1]
            low[strange], high[strange], size[strange] = 0, self.n, 0
            todo = np.flatnonzero(~strange)
            while len(todo):
                nearer, farther = self.step(symbol[todo], low[todo], high[todo])
                met = farther > nearer
                found = todo[met]
                low[found], high[found], size[found] = nearer[met], farther[met], size[found] + 1
                todo = todo[~met]  # a symbol of the index is found at the latest before the empty pattern
                if len(todo):
                    low[todo], high[todo], size[todo] = self._shortened(low[todo], high[todo])
            length[at], where[at] = size, low
        return length, where

    def least(self, where: np.ndarray) -> np.ndarray:
        """The least owner of matches of full depth, given by their first suffixes."""
        return self._least[where]
