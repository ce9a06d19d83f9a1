"""Pair merging of many slices at once, on arrays of symbol ids, and a bounded table of what was merged before."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = 1 << 30
#: Slices of more bytes are neither merged on arrays nor kept.
LONG = 64
_ODD = 0x9E3779B97F4A7C15
_TOGETHER = 1 << 15

#: Parts of a flat array of ids: the array, where each part begins, and how many ids it has.
Parts = tuple[np.ndarray, np.ndarray, np.ndarray]


def spread(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` that begin at ``start``, one after another."""
    past = np.cumsum(sizes)
    return flat[np.repeat(start - (past - sizes), sizes) + np.arange(int(past[-1]) if len(past) else 0)]


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """From (places, sizes, ids) that together have each place once: the ids in the order of places, and their sizes."""
    place, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.argsort(place)
    return spread(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]


class PairMerger:
    """Known pairs of symbols, each with a rank (distinct symbols that result have distinct ranks).

    Each pair stands in one of a few hash tables (what collides goes to the next, smaller one), so a look-up is a few
    gathers; pairs of the symbols that slices ``begin`` with stand in a square table.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, begin: np.ndarray) -> None:
        """``result[r]`` is the symbol that a pair of rank r gives."""
        n = len(left)
        self.keys, self.rank, self.result = np.append(left.astype(np.int64) << 32 | right, -1), np.append(rank.astype(np.int64), NONE), result.astype(np.int64)
        self.tables: list[tuple[np.ndarray, int, int]] = []
        rest = np.arange(n)
        while len(rest):
            bits, odd = max(8, int(4 * len(rest)).bit_length()), _ODD * (2 * len(self.tables) + 1) & 0xFFFFFFFFFFFFFFFF
            t = np.full(1 << bits, n, np.int32)
            at = self._at(self.keys[rest], bits, odd)
            t[at] = rest
            rest = rest[t[at] != rest]
            self.tables.append((t, bits, odd))
        self.small = np.zeros(int(max(begin.max(), left.max(initial=0), right.max(initial=0), result.max(initial=0))) + 1, np.int32)
        self.small[begin] = np.arange(len(begin))
        self.square = self.ranks(np.repeat(begin, len(begin)), np.tile(begin, len(begin))).astype(np.int32)
        self.width = len(begin)

    @staticmethod
    def _at(keys: np.ndarray, bits: int, odd: int) -> np.ndarray:
        x = keys.view(np.uint64)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(odd)) >> np.uint64(64 - bits)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or ``NONE``."""
        keys = a.astype(np.int64) << 32 | b
        out = np.full(len(keys), NONE, np.int64)
        for t, bits, odd in self.tables:
            at = t[self._at(keys, bits, odd)]
            hit = np.flatnonzero(self.keys[at] == keys)
            out[hit] = self.rank[at[hit]]
        return out

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the symbols of all slices one after another, and how many each has (one at least): what is left of them.

        In each round every slice that still has a known pair joins its pair of lowest rank, leftmost first.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bounds = np.append(0, np.cumsum(sizes))
        for a in range(0, len(sizes), _TOGETHER):
            b = min(a + _TOGETHER, len(sizes))
            self._merge(ids[bounds[a] : bounds[b]].astype(np.int64), sizes[a:b], np.arange(a, b), done)
        return joined(done)

    def _merge(self, ids: np.ndarray, sizes: np.ndarray, row: np.ndarray, done: list) -> None:
        last = np.cumsum(sizes) - 1
        small = self.small[ids]
        rank = np.append(self.square[small[:-1] * self.width + small[1:]], NONE).astype(np.int64)
        rank[last] = NONE
        while len(row):
            first = np.append(0, last[:-1] + 1)
            low = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            more = low >> 32 != NONE
            if not more.all():
                of = np.repeat(more, sizes)
                done.append((row[~more], sizes[~more], ids[~of]))
                before = np.cumsum(~of)
                low = low[more]
                low -= before[low & 0xFFFFFFFF]
                row, sizes, ids, rank = row[more], sizes[more], ids[of], rank[of]
                if not len(row):
                    break
            p = low & 0xFFFFFFFF
            ids[p] = self.result[low >> 32]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            ids, rank = ids[keep], rank[keep]
            p -= np.arange(len(p))
            sizes = sizes - 1
            last = np.cumsum(sizes) - 1
            first = last - sizes + 1
            rank[p] = NONE
            for at in (p[p < last], p[p > first] - 1):
                rank[at] = self.ranks(ids[at], ids[at + 1])


class Known:
    """Slices and their ids, as arrays; emptied when there are more than ``size``."""

    def __init__(self, size: int, kind: pa.DataType) -> None:
        self.size, self.kind = size, kind
        self.slices, self.flat, self.sizes = pa.array([], kind), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids_of(self, distinct: pa.Array, merged: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> Parts:
        """The ids of each of ``distinct`` slices; those that are new come from ``merged``."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.slices), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        start, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes
        if not len(new):
            return self.flat, start[at], sizes[at]
        slices = distinct.take(pa.array(new))
        flat, n = merged(slices)
        begin = np.cumsum(n) - n
        of = np.append(start, begin + len(self.flat)), np.append(sizes, n)
        at = at.astype(np.int64)
        at[new] = len(self.sizes) + np.arange(len(new))
        out = np.concatenate([self.flat, flat.astype(np.int32)]), of[0][at], of[1][at]
        keep = np.flatnonzero(pc.binary_length(slices).to_numpy() <= LONG)
        if len(self.sizes) + len(keep) > self.size:
            self.slices, self.flat, self.sizes = pa.array([], self.kind), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.slices = pa.concat_arrays([self.slices, slices.take(pa.array(keep))])
        self.flat = np.concatenate([self.flat, spread(flat.astype(np.int32), begin[keep], n[keep])])
        self.sizes = np.append(self.sizes, n[keep])
        return out


def octets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, one after another, and each one's length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    return np.frombuffer(data, np.uint8)[int(offsets[0]) : int(offsets[-1])], np.diff(offsets).astype(np.int64)
