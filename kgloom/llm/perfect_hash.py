"""A minimal perfect hash over 64-bit keys: levels of bit arrays, in which a key rests where it is alone."""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A finaliser of three multiply-shift rounds, different for each seed."""
    x = keys + np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * _GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def build(keys: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed levels of distinct keys, and for each key its index in 0..n-1."""
    levels, index, left, base = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = np.uint64(2 * len(left) + 7 & ~7)
        at = (mixed(keys[left], len(levels)) % size).astype(np.int64)
        bits = np.bincount(at, minlength=int(size)) == 1
        alone = bits[at]
        index[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        levels.append(np.packbits(bits))
        left = left[~alone]
    head = np.array([len(levels), *map(len, levels)], np.int64).tobytes()
    return head + b"".join(x.tobytes() for x in levels), index


def lookup(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """The index of each key; a key that was not built in gives any index, or -1."""
    out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    at, base = 8 * (n + 1), 0
    for level, size in enumerate(np.frombuffer(packed, np.int64, n, 8)):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, size, at)).astype(bool)
        at += int(size)
        where = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[where]
        out[left[hit]] = base + np.cumsum(bits)[where[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
        if not len(left):
            break
    return out
