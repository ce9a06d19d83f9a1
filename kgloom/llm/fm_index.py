"""An FM-index over a shard of words: suffix order, wavelet matrix over the last column, sampled suffix positions.

The text of a shard is a sequence of small whole numbers, word numbers from 1 up and 0 between pieces. Every 0 is a symbol
of its own, smaller than all words and ordered by position, so suffixes differ at the next 0 at the latest and the suffix
order takes as many doubling rounds as the longest piece asks for, however often a passage repeats.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order, by prefix doubling over the suffixes that are still tied."""
    n, ends = len(text), np.flatnonzero(text == 0)
    symbols = text.astype(np.int64) + len(ends)
    symbols[ends] = np.arange(len(ends))
    bits = int(symbols.max()).bit_length() + 1
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: max(0, n - i)] += symbols[i:] + 1
    order = np.argsort(key)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    while len(tied):
        at = order[tied]
        beyond = at + depth
        # A tied suffix goes on: it would have met its own 0 otherwise.
        pair = (rank[at] << 32) | rank[np.minimum(beyond, n - 1)]
        by = np.argsort(pair, kind="stable")
        order[tied] = at = at[by]
        pair = pair[by]
        new = np.concatenate([[True], np.diff(pair) != 0])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied, depth = tied[~(new & np.concatenate([new[1:], [True]]))], depth * 2
    return order


class FMIndex:
    """Over a text that begins with a word and ends with 0; ``starts`` are the positions where pieces begin."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, every: int = 8) -> None:
        order = suffix_order(text)
        last = text[order - 1].astype(np.int32)
        # What stands before a piece is no word; its own first position is always sampled, so no walk goes beyond it.
        kept = order % every == 0
        begins = np.zeros(len(text), bool)
        begins[starts] = True
        kept |= begins[order]
        self.size, self.kept = len(text), kept
        self.samples, self.sample_rank = order[kept], np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        counts = np.bincount(text)
        self.first = np.cumsum(counts) - counts
        self.levels, self.zeros = [], []
        self.depth = max(1, int(last.max()).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            down = bit == 0
            self.zeros.append(int(down.sum()))
            last = np.concatenate([last[down], last[~down]])
        # Where each symbol's run begins in the lowest level.
        self.runs = np.full(1 << self.depth, self.size, np.int64)
        if self.size:
            change = np.concatenate([[0], np.flatnonzero(np.diff(last)) + 1])
            self.runs[last[change]] = change

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the last column before row ``at``."""
        at = at.astype(np.int64)
        for level, ones, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            n = ones[at]
            at = np.where((symbols >> level) & 1, zeros + n, at - n)
        return at - self.runs[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The last column's symbols."""
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            n = ones[at]
            bit = ones[at + 1] - n
            out, at = out * 2 + bit, np.where(bit, zeros + n, at - n)
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes begin with each phrase; phrases end at the last column of their array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        width = phrases.shape[1]
        for step in range(width):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            c = phrases[alive, width - 1 - step].astype(np.int64)
            known = c < len(self.first)
            high[alive[~known]] = low[alive[~known]]
            alive, c = alive[known], c[known]
            begin = self.first[c]
            # A symbol that isn't in the last column has no run there.
            there = (c < len(self.runs)) & (self.runs[np.minimum(c, len(self.runs) - 1)] < self.size)
            high[alive[~there]] = low[alive[~there]]
            alive, c, begin = alive[there], c[there], begin[there]
            low[alive], high[alive] = begin + self.rank(c, low[alive]), begin + self.rank(c, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions where the rows' suffixes begin: steps back to the next sampled position, and forward by as many."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = self.kept[at[left]]
            done = left[here]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            left = left[~here]
            c = self.access(at[left])
            at[left] = self.first[c] + self.rank(c, at[left])
            steps[left] += 1
        return out
