"""Longest common extensions by recompression: a run-length grammar built by alternate block and pair compression.

Level 0 holds the symbols of a sequence. A block level replaces each maximal run of one symbol by a symbol for (symbol,
length); a pair level splits the alphabet in two by a hash and replaces each pair of a left and a right symbol that stand
side by side. Equal pieces of a level get equal symbols, so the levels are a grammar in which equal substrings share all
symbols but few at their ends. Levels shrink geometrically and are built with one hash table a level.

An extension query climbs while both places start a symbol, steps over at most one symbol a level to make them so, and
descends at a mismatch over at most two more. Thousands of queries climb and descend together, level by level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Symbols are dealt to the two sides of a pair level by bits of this multiple.
MIX = np.uint64(0x9E3779B97F4A7C15)


class Level:
    """Symbols of one level and, except for the first, where each begins in the level below."""

    def __init__(self, symbols: np.ndarray, below: np.ndarray | None, block: bool):
        self.symbols, self.block = symbols, block
        self.below = below                                        # first symbol one level down; one more entry at the end
        self.above: np.ndarray | None = None                      # symbol one level up, and ...
        self.inner: np.ndarray | None = None                      # ... how many symbols of this level lie before it in that one


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    return pd.factorize((left << 32) | right)[0].astype(np.int64)


def _blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return _named(s[first], np.diff(np.concatenate([first, [len(s)]]))), first


def _pairs(s: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray]:
    side = ((((s.astype(np.uint64) + np.uint64(2 * round_ + 1)) * MIX) >> np.uint64(40)) & np.uint64(1)).astype(bool)
    ab, ba = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
    joined = ab if ab.sum() >= ba.sum() else ba                   # the side that makes more pairs is the left one
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    second = np.zeros(len(first), np.int64)
    paired = np.diff(np.concatenate([first, [len(s)]])) == 2
    second[paired] = s[first[paired] + 1] + 1
    return _named(s[first], second), first


class Grammar:
    """Run-length grammar of a sequence of non-negative integers below 2^31."""

    def __init__(self, sequence: np.ndarray):
        symbols = pd.factorize(sequence)[0].astype(np.int64)
        self.levels = [Level(symbols, None, False)]
        while len(symbols) > 1 and int(symbols.max()) + 1 < len(symbols):    # all different: nothing more to share
            runs = bool((symbols[1:] == symbols[:-1]).any())                 # a block level without runs would change nothing
            symbols, first = _blocks(symbols) if runs else _pairs(symbols, len(self.levels))
            low = self.levels[-1]
            begins = np.zeros(len(low.symbols), np.int64)
            begins[first] = 1
            low.above = np.cumsum(begins) - 1
            low.inner = np.arange(len(low.symbols)) - first[low.above]
            self.levels.append(Level(symbols, np.concatenate([first, [len(low.symbols)]]), runs))
        # Where each symbol of a level begins in the sequence.
        self.starts = [np.arange(len(sequence) + 1)]
        for level in self.levels[1:]:
            self.starts.append(self.starts[-1][level.below])

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes from i and from j; i < j <= length."""
        i0, x, y = i, i.astype(np.int64), j.astype(np.int64)
        out = np.full(len(x), -1, np.int64)
        alive = np.arange(len(x))
        stopped: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.levels]
        for k, level in enumerate(self.levels):                    # up
            size = len(level.symbols)
            x, y, alive = self._differ(k, x, y, alive, stopped, out, i0)
            if level.above is None:                                # the top: all its symbols differ
                if len(alive):
                    stopped[k].append((x, y, alive))
                break
            a, b = level.inner[x], level.inner[y]
            up = self.levels[k + 1]
            if up.block:
                # The rest of each block is the same symbol: pass the smaller rest; equal rests end together.
                left, right = up.below[level.above[x] + 1] - x, up.below[level.above[y] + 1] - y
                step = np.where((a == 0) & (b == 0), 0, np.minimum(left, right))
                x, y = x + step, y + step
                x, y, alive = self._ended(x, y, alive, size, out, i0, k)
                x, y, alive = self._differ(k, x, y, alive, stopped, out, i0)
            else:
                # Equal symbols stand on the same side; a right one that is paired here or there ends on both.
                step = ((a > 0) | (b > 0)).astype(np.int64)
                x, y = x + step, y + step
                x, y, alive = self._ended(x, y, alive, size, out, i0, k)
                x, y, alive = self._differ(k, x, y, alive, stopped, out, i0)
            x, y = level.above[x], level.above[y]
        for k in range(len(self.levels) - 1, 0, -1):               # down
            if not stopped[k]:
                continue
            x, y, alive = (np.concatenate(c) for c in zip(*stopped[k]))
            level, low = self.levels[k], self.levels[k - 1]
            if level.block:
                # Blocks of one symbol share the shorter one's length.
                p, q = level.below[x], level.below[y]
                same = low.symbols[p] == low.symbols[q]
                step = np.where(same, np.minimum(level.below[x + 1] - p, level.below[y + 1] - q), 0)
                x, y = p + step, q + step
            else:
                x, y = level.below[x], level.below[y]
                step = (low.symbols[x] == low.symbols[y]).astype(np.int64)
                x, y = x + step, y + step
            x, y, alive = self._ended(x, y, alive, len(low.symbols), out, i0, k - 1)
            stopped[k - 1].append((x, y, alive))
        for x, y, alive in stopped[0]:
            out[alive] = x - i0[alive]
        return out

    def _ended(self, x, y, alive, size, out, i0, k):
        """Queries that reached the end of the sequence are answered."""
        end = np.maximum(x, y) >= size
        if end.any():
            done = alive[end]
            out[done] = self.starts[k][x[end]] - i0[done]
            x, y, alive = x[~end], y[~end], alive[~end]
        return x, y, alive

    def _differ(self, k, x, y, alive, stopped, out, i0):
        """Queries whose symbols differ on level k go down from here."""
        x, y, alive = self._ended(x, y, alive, len(self.levels[k].symbols), out, i0, k)
        s = self.levels[k].symbols
        unlike = s[x] != s[y]
        if unlike.any():
            stopped[k].append((x[unlike], y[unlike], alive[unlike]))
            x, y, alive = x[~unlike], y[~unlike], alive[~unlike]
        return x, y, alive
