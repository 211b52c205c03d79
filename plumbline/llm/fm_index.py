"""A compressed full-text index of short word sequences: suffix order, Burrows-Wheeler transform in a
wavelet matrix of packed bits, and backward search for many patterns side by side."""

from __future__ import annotations

import numpy as np

PROBE = 4


class WaveletMatrix:
    """Rank queries over symbols below 2**levels; bits are packed 64 to a word with one 32-bit count a word."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels, self.words, self.sums, self.zeros = levels, [], [], []
        n = len(symbols)
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros((n // 64 + 1) * 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            sums = np.zeros(len(words), np.uint32)
            np.cumsum(np.bitwise_count(words)[:-1], out=sums[1:])
            self.words.append(words)
            self.sums.append(sums)
            self.zeros.append(n - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # Where the occurrences of each symbol begin in the last level's order.
        c = np.arange(1 << levels)
        self.start = self._down(c, np.zeros(len(c), np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            words, sums = self.words[level], self.sums[level]
            block = i >> 6
            ones = sums[block].astype(np.int64) + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (self.levels - 1 - level)) & 1 > 0, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c comes before position i."""
        return self._down(c, i) - self.start[c]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling. Every suffix must be unique."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Index of several sequences of word codes; ``first`` has the start of each, and one more.

    ``weights`` tell how often each sequence is there; copies need not be in the index themselves.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray, weights: np.ndarray | None = None) -> None:
        n_seq = len(first) - 1
        self.codes = np.unique(codes, return_inverse=True)[1].astype(np.int32) + 1
        self.first = first
        sigma = int(self.codes.max(initial=0)) + 1
        ends = first[1:] + np.arange(n_seq)
        text = np.zeros(len(codes) + n_seq, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = self.codes
        unique = text + n_seq
        unique[ends] = np.arange(n_seq)  # separators are all different and come before the words
        order = suffix_order(unique)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        count = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(count)])
        self.n = len(text)
        # Of the suffixes in order, how often those before each place are there.
        times = np.ones(n_seq, np.int64) if weights is None else np.minimum(weights, 2)
        self.times = np.concatenate([[0], np.cumsum(np.repeat(times, np.diff(first) + 1)[order])])

    def repeated(self, sequences: np.ndarray, window: int) -> list[tuple[int, int, int]]:
        """(sequence, from, to): maximal runs of at least ``window`` words of the given sequences that occur
        twice or more in the index, by matching statistics from right to left.

        A search goes back from an end while there are two occurrences. If it stops too early, a short
        probe around the word where it stopped tells whether all windows over that place can be skipped.
        """
        out: list[tuple[int, int, int]] = []
        base = self.first[sequences]
        end = self.first[sequences + 1] - base
        live = np.flatnonzero(end >= window)
        start = end.copy()
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        resume = np.full(len(end), -1, np.int64)  # where the main search goes on if the probe finds its pattern
        while len(live):
            c = self.codes[base[live] + start[live] - 1].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]])) + np.tile(self.before[c], 2)
            low, high = both[: len(c)], both[len(c) :]
            ok = self.times[high] - self.times[low] >= 2
            went = live[ok]
            start[went] -= 1
            lo[went], hi[went] = low[ok], high[ok]
            probing = resume[live] >= 0
            size = end[live] - start[live]
            done = ~ok | (start[live] == 0) | (probing & (size >= 2 * PROBE + 1))
            for q in live[done & ~probing & (size >= window)]:
                out.append((int(sequences[q]), int(start[q]), int(end[q])))
            at = live[done]
            p, good, n = probing[done], ok[done], size[done]
            s, e = start[at], end[at]
            # A probe that fails rules out the windows over it; the ends up to its own may be passed over if all
            # windows that end there begin before the place where it failed.
            passed = ~good & (resume[at] - window <= s - 1)
            next_end = np.where(p, np.where(passed, e - 1, resume[at]), np.where(n >= window, s + window - 1, e - 1))
            next_end = np.where(~p & good, 0, next_end)  # reached the beginning: nothing is left of it
            probe = ~p & ~good & (n > PROBE + 1) & (n < window)
            resume[at] = np.where(probe, e - 1, -1)
            next_end = np.where(probe, np.minimum(s + PROBE, e), next_end)
            end[at] = next_end
            start[at] = next_end
            lo[at], hi[at] = 0, self.n
            stop = np.zeros(len(end), bool)
            stop[at] = (next_end < window) & ~probe
            live = live[~stop[live]]
        return out
