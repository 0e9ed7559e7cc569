"""An FM-index over one shard of symbols: wavelet-tree ranks, batched backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

BITS = 5
#: Every SAMPLE-th text position is stored; others are found by walking back to one.
SAMPLE = 16


class WaveletTree:
    """Ranks over a sequence of BITS-bit symbols, one plane of prefix counts per bit."""

    def __init__(self, sequence: np.ndarray):
        self.planes: list[tuple[np.ndarray, int]] = []
        self.length = len(sequence)
        for b in range(BITS - 1, -1, -1):
            bit = (sequence >> b) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append((ones, len(sequence) - int(ones[-1])))
            set_ = bit.astype(bool)
            sequence = np.concatenate([sequence[~set_], sequence[set_]])
        every = np.arange(1 << BITS)
        self.base = self._down(every, np.zeros(1 << BITS, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at[i] ends up among the symbols symbol[i] in the last plane's order."""
        for k, (ones, zeros) in enumerate(self.planes):
            one = ((symbol >> (BITS - 1 - k)) & 1).astype(bool)
            l1 = ones[at]
            at = np.where(one, zeros + l1, at - l1)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i], for many i at once."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in self.planes:
            l1 = ones[at]
            one = ones[at + 1] > l1
            at = np.where(one, zeros + l1, at - l1)
            symbol = (symbol << 1) | one
        return symbol, at - self.base[symbol]


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start of every suffix in full order; ``s`` ends with a symbol that stands nowhere else.

    Suffixes are sorted by their first twelve symbols; those still tied are sorted by the
    rank of what follows, which doubles the symbols compared in every pass.
    """
    n = len(s)
    wide = np.concatenate([s, np.zeros(16, np.uint8)]).astype(np.int64)
    k2 = (wide[:-1] << BITS) | wide[1:]
    k4 = (k2[:-2] << 2 * BITS) | k2[2:]
    k8 = (k4[:-4] << 4 * BITS) | k4[4:]
    key = (k8[:n] << 4 * BITS) | k4[8:8 + n]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)
    places = np.arange(n)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(new, places, 0))
    rank[order] = first
    tied = ~(new & np.concatenate([new[1:], [True]]))
    places = places[tied]
    depth = 12
    while len(places):
        which = order[places]
        follow = which + depth
        key = rank[which] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key)
        which, key = which[by], key[by]
        order[places] = which  # groups keep their places, as the rank is the key's high part
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[which] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~(new & np.concatenate([new[1:], [True]]))
        places = places[tied]
        depth *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        """``symbols`` in 1 .. 2**BITS-1; a terminal 0 is added."""
        s = np.concatenate([symbols, np.zeros(1, np.uint8)])
        order = suffix_order(s)
        self.length = len(s)
        self.tree = WaveletTree(s[order - 1])  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << BITS))]).astype(np.int64)
        sampled = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, one per row, by backward search."""
        p, m = patterns.shape
        lo, hi = np.zeros(p, np.int64), np.full(p, self.length, np.int64)
        alive = np.arange(p)
        for k in range(m - 1, -1, -1):
            c = patterns[alive, k].astype(np.int64)
            ends = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = self.before[c] + ends[:len(c)], self.before[c] + ends[len(c):]
            alive = alive[hi[alive] > lo[alive]]
        dead = np.ones(p, bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, text position) of every occurrence in the ranges, each walked back to a sampled position."""
        counts = hi - lo
        which = np.repeat(np.arange(len(lo)), counts)
        at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        position = np.empty(len(which), np.int64)
        left = np.arange(len(which))
        for steps in range(SAMPLE):
            here = self.marks[at]
            hit = self.marks[at + 1] > here
            position[left[hit]] = self.samples[here[hit]] + steps
            left, at = left[~hit], at[~hit]
            if not len(left):
                break
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
        return which, position
