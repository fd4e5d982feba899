"""An FM-index over the words of one shard: suffix order, wavelet matrix, backward search, locate.

The text is a sequence of symbols; 0 separates segments and never occurs in a pattern. Suffixes are
compared up to the end of their segment, ties by position, which is the order that distinct
separators growing by position would give. So last-to-first steps are exact inside segments.
"""

from __future__ import annotations

import numpy as np

from changelake.llm.text import ragged

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; only unresolved groups are sorted again."""
    n = len(text)
    bits = max(1, int(text.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    for j in range(width):
        symbol = np.where(open_, padded[j:j + n], 0)
        open_ &= symbol > 0
        key = (key << bits) | symbol
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    # a suffix whose segment ends inside the compared part is tied with its equals by position alone
    head |= ~open_[order]
    length = width
    while True:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        again = np.flatnonzero(~head)
        if not len(again):
            return order
        rank = np.empty(n, np.int64)
        rank[order] = group
        rank = np.append(rank, -1)
        member = np.zeros(n, bool)                        # everyone in a group of two or more
        member[again] = True
        member[group[again]] = True
        at = np.flatnonzero(member)
        pos = order[at]
        # an unresolved suffix has no separator in its first ``length`` symbols, so pos + length <= n
        second = rank[np.minimum(pos + length, n)]
        inner = np.lexsort((pos, second, group[at]))
        order[at] = pos[inner]
        g, s = group[at][inner], second[inner]
        head[at] = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        length *= 2


class WaveletMatrix:
    """Rank queries: how often a symbol occurs before a position."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[int] = []
        self.before: list[np.ndarray] = []                # ones before each position, per level
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.before.append(count)
            self.zeros.append(len(values) - int(count[-1]))
            ones = bit.astype(bool)
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        lo, at = np.zeros_like(position), position
        for i, count in enumerate(self.before):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            lo1, at1 = count[lo], count[at]
            lo = np.where(one, self.zeros[i] + lo1, lo - lo1)
            at = np.where(one, self.zeros[i] + at1, at - at1)
        return at - lo

    def access(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank before the position)."""
        symbol, lo, at = np.zeros_like(position), np.zeros_like(position), position
        for i, count in enumerate(self.before):
            one = (count[at + 1] - count[at]).astype(bool)
            symbol = (symbol << 1) | one
            lo = np.where(one, self.zeros[i] + count[lo], lo - count[lo])
            at = np.where(one, self.zeros[i] + count[at], at - count[at])
        return symbol, at - lo


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """``text`` holds numbers from 0 (separator) to symbols - 1."""
        # the closing separator gives the last word a suffix that it precedes
        text = np.append(np.asarray(text, np.int64), 0)
        self.n = len(text)
        order = suffix_order(text)
        last = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(last, max(1, int(symbols - 1).bit_length()))
        # every SAMPLE-th position is stored, and the first of each segment, where steps must stop
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of each pattern (rows, left-aligned), found from its end backwards."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] if len(patterns) else 0):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - step]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence: step back to the next stored position."""
        pattern = np.repeat(np.arange(len(lo)), hi - lo)
        at, steps = ragged(lo, hi - lo), np.zeros(len(pattern), np.int64)
        position, todo = np.zeros(len(pattern), np.int64), np.arange(len(pattern))
        while len(todo):
            here = self.kept[at[todo]]
            found = todo[here]
            position[found] = self.samples[self.kept_before[at[found]]] + steps[found]
            todo = todo[~here]
            symbol, rank = self.wavelet.access(at[todo])
            at[todo] = self.first[symbol] + rank
            steps[todo] += 1
        return pattern, position
