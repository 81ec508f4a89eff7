"""FM-indexes in numpy: many searches move together, a symbol at a time."""

from __future__ import annotations

import numpy as np


class Index:
    """FM-index of a ring of symbols: suffix ranks, and the symbol before each in a wavelet matrix.

    Suffixes are sorted by their first ``depth`` symbols (without it, by all): enough for
    patterns of that length, since a step asks only which suffixes one symbol shorter match.
    """

    def __init__(self, ring: np.ndarray, depth: int | None = None):
        self.size, top = len(ring), int(ring.max()) + 1
        self.suffixes = self._sorted(ring, depth or self.size)
        before = ring[self.suffixes - 1]
        self.depth = max(1, (top - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=top))])
        self.zeros, self.bits, self.ones = [], [], []
        row, start = before.astype(np.int64), np.zeros(top, np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            bytes_ = np.packbits(bit, bitorder="little")
            packed[: len(bytes_)] = bytes_
            words = packed.view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(int(self.size - bit.sum()))
            at = self._rank(len(self.bits) - 1, start)
            start = np.where(np.arange(top) >> level & 1, self.zeros[-1] + at, start - at)
            row = np.concatenate([row[~bit], row[bit]])
        self.start = start

    @staticmethod
    def _sorted(ring: np.ndarray, depth: int) -> np.ndarray:
        """Positions in the order of what the ring reads from them on, by doubling."""
        n, wide = len(ring), max(1, int(ring.max()).bit_length())
        key, have = np.zeros(n, np.int64), max(1, min(62 // wide, n))
        for k in range(have):
            key = key << wide | np.roll(ring, -k)
        values, rank = np.unique(key, return_inverse=True)
        while len(values) < n and have < depth:
            values, rank = np.unique(rank * n + np.roll(rank, -have), return_inverse=True)
            have *= 2
        return np.argsort(rank, kind="stable")

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a level."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        part = self.bits[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(part)

    def step(self, symbol: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals with one more symbol in front: start, size, and how many smaller symbols there were."""
        lo, hi, less = lo, lo + size, np.zeros(len(lo), np.int64)
        for k in range(self.depth):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            a, b = self._rank(k, lo), self._rank(k, hi)
            less += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return self.first[symbol] + lo - self.start[symbol], hi - lo, less

    def children(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols in front of each interval: source, symbol, and what ``step`` gives."""
        source, symbol, hi, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), lo + size, np.zeros(len(lo), np.int64)
        for k in range(self.depth):
            a, b = self._rank(k, lo), self._rank(k, hi)
            zero, one = np.flatnonzero(hi - b > lo - a), np.flatnonzero(b > a)
            less = np.concatenate([less[zero], less[one] + (hi - b - lo + a)[one]])
            lo, hi = (np.concatenate([(x - y)[zero], self.zeros[k] + y[one]]) for x, y in ((lo, a), (hi, b)))
            symbol = np.concatenate([symbol[zero] * 2, symbol[one] * 2 + 1])
            source = np.concatenate([source[zero], source[one]])
        return source, symbol, self.first[symbol] + lo - self.start[symbol], hi - lo, less


class Matcher:
    """Matching statistics of streamed sequences against an index, up to ``depth`` symbols."""

    def __init__(self, ring: np.ndarray, depth: int):
        self.index, self.depth = Index(ring, depth), depth
        at, alike = self.index.suffixes, np.ones(len(ring), bool)
        alike[0] = False
        #: Symbols that a suffix shares with the one ranked before it, ``depth`` at most.
        self.common = np.zeros(len(ring) + 1, np.int64)
        for k in range(depth):
            symbol = ring[(at + k) % len(ring)]
            alike[1:] &= symbol[1:] == symbol[:-1]
            self.common[:-1] += alike
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Per rank, where the suffixes that share its first ``length`` symbols begin and end."""
        if length not in self._blocks:
            edge = self.common < length
            edge[[0, -1]] = True
            cuts = np.flatnonzero(edge)
            of = np.cumsum(edge[:-1]) - 1
            self._blocks[length] = cuts[of], cuts[of + 1]
        return self._blocks[length]

    def _shorten(self, lo, size, length, rows, to) -> None:
        """Let go of the last symbols of some matches, down to length ``to`` each."""
        for k in np.unique(to).tolist():
            own = rows[to == k]
            begin, end = self.block(k)
            size[own] = end[lo[own]] - begin[lo[own]]
            lo[own] = begin[lo[own]]
            length[own] = k

    def statistics(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, first rank and number of ranks of the longest match from each position on.

        Positions of all sequences in a row. A symbol is at least 1, or -1 where the index has
        none like it. Sequences are read backwards: a match grows by the symbol before it, and
        lets go of symbols at its end as long as no suffix begins with that.
        """
        sizes = np.array([len(s) for s in sequences], np.int64)
        ends, order = np.cumsum(sizes), np.argsort(-sizes, kind="stable")
        flat = np.concatenate([*sequences, np.zeros(0, np.int64)]).astype(np.int64)
        out = tuple(np.zeros(len(flat), np.int64) for _ in range(3))
        n = len(order)
        lo, size, length = np.zeros(n, np.int64), np.full(n, self.index.size), np.zeros(n, np.int64)
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes[order], -k, "left"))  # sequences of more than k symbols
            at = ends[order[:n]] - 1 - k
            symbol = flat[at]
            long = np.flatnonzero(length[:n] == self.depth)
            self._shorten(lo, size, length, long, np.full(len(long), self.depth - 1))
            unknown = np.flatnonzero(symbol < 0)
            self._shorten(lo, size, length, unknown, np.zeros(len(unknown), np.int64))
            todo = np.flatnonzero(symbol >= 0)
            while len(todo):
                new, left, _ = self.index.step(symbol[todo], lo[todo], size[todo])
                some = left > 0
                done = todo[some]
                lo[done], size[done] = new[some], left[some]
                length[done] += 1
                todo = todo[~some]
                # the shortest loss that takes in more suffixes
                self._shorten(lo, size, length, todo, np.maximum(self.common[lo[todo]], self.common[lo[todo] + size[todo]]))
            for row, value in zip(out, (length, lo, size)):
                row[at] = value[:n]
        return out
