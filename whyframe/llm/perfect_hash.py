"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Keys go through levels of bit arrays: a key that is alone at its place on a
level takes it, the others try the next level. The number of bits set before a
key's bit is its index, so n keys get the indices 0 to n - 1. A key is found
on the first level with a probability over one half, hence in constant
expected time.
"""

from __future__ import annotations

import numpy as np

from .text_kernels import U64, mix

BLOCK = 512


def place_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], dtype=U64) * U64(0x9E3779B97F4A7C15))) % U64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: packed bits (little-endian within bytes), each a multiple of 512 bits long."""
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            total += int(ones.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        """keys: distinct uint64."""
        levels, left = [], keys.astype(U64)
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys must be distinct")
            size = -(-max(BLOCK, int(gamma * len(left))) // BLOCK) * BLOCK
            place = place_of(left, len(levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[place[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little"))
            left = left[~alone]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or any index for keys that were not there when it was built."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = place_of(keys[open_], level, len(bits) * 8)
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            found, at = open_[hit], place[hit]
            block = at // BLOCK
            rows = bits.reshape(-1, BLOCK // 8)[block]
            inside = at % BLOCK
            byte = np.arange(BLOCK // 8)
            full = np.where(byte[None, :] < (inside >> 3)[:, None], np.bitwise_count(rows), 0).sum(axis=1, dtype=np.int64)
            last = np.bitwise_count(rows[np.arange(len(at)), inside >> 3] & ((1 << (inside & 7)) - 1).astype(np.uint8))
            out[found] = self.ranks[level][block] + full + last
            open_ = open_[~hit]
            if not len(open_):
                break
        return out
