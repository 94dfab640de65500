"""A minimal perfect hash over 128-bit keys (two int64 arrays), with fingerprint and count arrays.

Level by level, keys hash into a bit array; keys that are alone at their bit are placed there, the
others go to the next, smaller level. A key's slot is the number of bits set before its own.
"""

from __future__ import annotations

import numpy as np

LEVELS, LOAD = 64, 1.5


def _mix(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the key for a level: a multiply-xorshift mixer."""
    x = high.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ low.view(np.uint64)
    return x ^ (x >> np.uint64(29))


class LineIndex:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> LineIndex:
        """Keys must be distinct; counts are stored in the fewest bytes that hold the largest."""
        left, sizes, bits = np.arange(len(high)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = int(LOAD * len(left)) + 8
            at = (_mix(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            row = np.zeros(size, dtype=bool)
            row[at[alone]] = True
            sizes.append(size)
            bits.append(row)
            left = left[~alone]
        if len(left):
            raise ValueError("keys of a line index must be distinct")
        width = np.min_scalar_type(int(counts.max(initial=0)))
        index = cls(np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, dtype=bool), np.zeros(len(high), np.uint32), np.zeros(len(high), width))
        slot = index.slots(high, low)
        index.prints[slot] = low.view(np.uint64).astype(np.uint32)
        index.counts[slot] = counts
        return index

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that no level holds."""
        out, left = np.full(len(high), -1, dtype=np.int64), np.arange(len(high))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + (_mix(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the fingerprint says that it isn't indexed."""
        slot = self.slots(high, low)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == low[found].view(np.uint64).astype(np.uint32)
        out = np.zeros(len(high), dtype=np.uint64)
        out[found] = self.counts[slot[found]]
        return out

    def to_bytes(self) -> bytes:
        """The number of levels and of keys and the width of a count, then sizes, bits, fingerprints and counts."""
        head = np.array([len(self.sizes), len(self.prints), self.counts.itemsize], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.sizes, np.packbits(self.bits), self.prints, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        levels, keys, width = np.frombuffer(data, np.int64, 3).tolist()
        sizes = np.frombuffer(data, np.int64, levels, 24)
        size, at = int(sizes.sum()), 24 + 8 * levels
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool)
        at += -(-size // 8)
        return cls(sizes, bits, np.frombuffer(data, "<u4", keys, at), np.frombuffer(data, f"<u{width}", keys, at + 4 * keys))
