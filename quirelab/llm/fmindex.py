"""A compressed FM-index over sequences of integers, with a wavelet matrix for rank."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an integer sequence in order, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + shifted
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before position i; one bit vector per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        s = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            packed = np.zeros((len(s) >> 6) + 1, np.uint64)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=ones[1:])
            self.bits.append(packed)
            self.before.append(ones)
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # Where the run of each symbol starts in the last order: where position 0 goes.
        self.start = np.zeros(sigma, np.int64)
        self.start = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            low = self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[k][word] + np.bitwise_count(low)
            i = np.where((c >> level) & 1, self.zeros[k] + ones, i - ones)
        return i - self.start[c]


class FMIndex:
    """Backward search over a collection of sequences (concatenated, with their lengths).

    Symbols may be any integers. Between sequences stand separators that compare by position, so
    no match runs over a border.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.vocabulary, ids = np.unique(symbols, return_inverse=True)
        m = len(lengths)
        ends = np.cumsum(lengths)
        text = np.empty(len(ids) + m, np.int64)
        sep = ends + np.arange(m)
        inside = np.ones(len(text), bool)
        inside[sep] = False
        text[inside] = ids + m
        text[sep] = np.arange(m)
        order = suffix_array(text)
        bwt = np.maximum(text[order - 1] - m + 1, 0)  # separators are one symbol, 0, never searched
        self.sigma = len(self.vocabulary) + 1
        self.tree = WaveletMatrix(bwt, self.sigma)
        counts = np.bincount(bwt, minlength=self.sigma)
        self.c = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.n = len(text)

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as the index numbers them (from 1); 0 for those it does not hold."""
        at = np.minimum(np.searchsorted(self.vocabulary, symbols), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == symbols, at + 1, 0)

    def matching(self, ids: np.ndarray, run: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed sequences, cut at ``depth`` symbols.

        ``run``: how many symbols of its sequence end at each position. Returns the end positions
        whose last ``depth`` symbols occur at least ``least`` times in the index, and the bounds
        of their suffix range. A search ends as soon as its range is smaller.
        """
        at = np.flatnonzero((run >= depth) & (ids > 0))
        lo, hi = self.c[ids[at]], np.append(self.c, self.n)[ids[at] + 1]
        for back in range(1, depth):
            keep = hi - lo >= least
            at, lo, hi = at[keep], lo[keep], hi[keep]
            c = ids[at - back]
            known = c > 0
            at, lo, hi, c = at[known], lo[known], hi[known], c[known]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.c[c] + both[: len(c)], self.c[c] + both[len(c) :]
        keep = hi - lo >= least
        return at[keep], lo[keep], hi[keep]
