"""Static binary-fuse filters over 64-bit keys (Graf and Lemire, 2022), built and probed in numpy."""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(_U) + _U(seed)
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


class BinaryFuse:
    """8-bit fingerprints, three slots a key: about 9 to 10 bits a key, false positives about 1 in 256, no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> list[np.ndarray]:
        mask = _U(segment - 1)
        first = ((h >> _U(32)) * _U(segment * segments)) >> _U(32)
        second = (first + _U(segment)) ^ ((h >> _U(18)) & mask)
        third = (first + _U(2 * segment)) ^ (h & mask)
        return [x.astype(np.int64) for x in (first, second, third)]

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(np.asarray(keys, dtype=_U))
        n = len(keys)
        segment = 1 << min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        size = (segments + 2) * segment
        for attempt in range(100):
            seed = 0x9E3779B97F4A7C15 * (attempt + 1) & (2**64 - 1)
            h = _mix(keys, seed)
            slots = cls._slots(h, segment, segments)
            order = cls._peel(slots, n, size)
            if order is None:
                continue
            prints, table = cls._prints(h), np.zeros(size, np.uint8)
            for own, free in reversed(order):
                value = prints[own]
                for s in slots:
                    value = value ^ table[s[own]]  # the free slot is still 0
                table[free] = value
            return cls(seed, segment, segments, table)
        raise RuntimeError("no binary fuse filter found in 100 seeds")

    @staticmethod
    def _peel(slots, n: int, size: int):
        """Rounds of (keys, their free slots); keys of a round share no free slot, so they are assigned together."""
        count = sum(np.bincount(s, minlength=size) for s in slots)
        held = np.zeros(size, np.int64)
        ids = np.arange(n, dtype=np.int64)
        for s in slots:
            np.bitwise_xor.at(held, s, ids)
        order, left = [], n
        free = np.flatnonzero(count == 1)
        while len(free):
            own, at = np.unique(held[free], return_index=True)
            order.append((own, free[at]))
            left -= len(own)
            for s in slots:
                np.subtract.at(count, s[own], 1)
                np.bitwise_xor.at(held, s[own], own)
            near = np.unique(np.concatenate([s[own] for s in slots]))
            free = near[count[near] == 1]
        return order if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, dtype=_U), self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return self._prints(h) == (self.table[a] ^ self.table[b] ^ self.table[c])

    def to_bytes(self) -> bytes:
        head = np.array([self.seed, self.segment, self.segments], _U)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "BinaryFuse":
        seed, segment, segments = (int(x) for x in np.frombuffer(data[:24], _U))
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint8))
