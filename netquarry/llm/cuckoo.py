"""Cuckoo filters (Fan et al., 2014) with insertion and deletion of whole batches, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
SLOTS, ROUNDS, LOAD = 4, 500, 0.8


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


class Full(Exception):
    """The batch does not fit; rebuild the shard from its exact table."""


class Cuckoo:
    """16-bit fingerprints, four slots a bucket, two buckets a key. Each inserted key holds one slot, so a deletion takes back exactly one insertion."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> "Cuckoo":
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys / (SLOTS * LOAD)))))), SLOTS), np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> "Cuckoo":
        size = len(keys)
        while True:
            made = cls.sized(size)
            try:
                made.insert(keys)
                return made
            except Full:
                size *= 2

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(np.asarray(keys, _U))
        prints = (h >> _U(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h & _U(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (_mix(prints.astype(_U) + _U(0x51ED2701)) & _U(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, at = self._of(keys)
        there = self._other(prints, at)
        return (self.table[at] == prints[:, None]).any(1) | (self.table[there] == prints[:, None]).any(1)

    def _place(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits into free slots of its bucket; the mask of what was left over."""
        order = np.argsort(at, kind="stable")
        buckets = at[order]
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        rank = np.arange(len(buckets)) - np.repeat(starts, np.diff(np.r_[starts, len(buckets)]))
        taken = self.table[buckets] != 0
        fits = rank < SLOTS - taken.sum(1)
        free = np.argsort(taken, axis=1, kind="stable")
        self.table[buckets[fits], free[fits, rank[fits]]] = prints[order][fits]
        left = np.zeros(len(at), bool)
        left[order[~fits]] = True
        return left

    def insert(self, keys: np.ndarray) -> None:
        """Insert a batch; raises Full (leaving the filter unusable) if it does not fit."""
        prints, at = self._of(keys)
        for turn in range(ROUNDS):
            for _ in range(2):
                if not len(prints):
                    return
                left = self._place(prints, at)
                prints, at = prints[left], at[left]
                at = self._other(prints, at)
            buckets, first = np.unique(at, return_index=True)
            slot = (turn + buckets) % SLOTS
            out = self.table[buckets, slot].copy()
            self.table[buckets, slot] = prints[first]
            prints[first] = out
            at[first] = self._other(out, buckets)
        if len(prints):
            raise Full(f"{len(prints)} fingerprints left over")

    def delete(self, keys: np.ndarray) -> None:
        """Take back one earlier insertion of each key."""
        prints, at = self._of(keys)
        for _ in range(2):
            while len(prints):
                hit = self.table[at] == prints[:, None]
                has = hit.any(1)
                spot = at * SLOTS + hit.argmax(1)
                rows = np.flatnonzero(has)
                if not len(rows):
                    break
                cells, first = np.unique(spot[rows], return_index=True)
                self.table.reshape(-1)[cells] = 0
                gone = np.zeros(len(prints), bool)
                gone[rows[first]] = True
                prints, at = prints[~gone], at[~gone]
            at = self._other(prints, at)
        if len(prints):
            raise KeyError(f"{len(prints)} keys were never inserted")

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Cuckoo":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())
