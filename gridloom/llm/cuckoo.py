"""A cuckoo filter in numpy: sets of 128-bit keys with bulk insert, delete and lookup.

Each key has a 16-bit fingerprint in one of two buckets of four; the second bucket follows from the
first and the fingerprint, so keys can be moved and deleted without knowing them. A filter that
gets too full raises ``Full``; its owner builds a larger one from the exact keys.
"""

from __future__ import annotations

import struct

import numpy as np

from gridloom.llm.textkit import mix

SLOTS = 4
LOAD = 0.6
KICKS = 200


class Full(Exception):
    pass


class Cuckoo:
    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            need = max(1, int(n_keys / (LOAD * SLOTS)) + 1)
            table = np.zeros((1 << (need - 1).bit_length(), SLOTS), np.uint16)
        self.table = table

    @property
    def _mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (lo.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (mix(hi.view(np.uint64)) & self._mask).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, place: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (place.astype(np.uint64) ^ (mix(fp.astype(np.uint64)) & self._mask)).astype(np.int64)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Add keys that are not in the set yet."""
        fp, one, two = self._places(hi, lo)
        wait = np.arange(len(fp))
        for place in (one, two):
            if not len(wait):
                return
            wait = wait[np.argsort(place[wait], kind="stable")]
            at = place[wait]
            new = np.concatenate(([True], at[1:] != at[:-1]))
            rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            free = self.table[at] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[at[fits], slot] = fp[wait[fits]]
            wait = wait[~fits]
        for i in wait:
            self._push(int(fp[i]), int(two[i]))

    def _push(self, fp: int, at: int) -> None:
        for kick in range(KICKS):
            row = self.table[at]
            empty = np.flatnonzero(row == 0)
            if len(empty):
                row[empty[0]] = fp
                return
            slot = kick % SLOTS
            fp, row[slot] = int(row[slot]), fp
            at = int(self._other(np.array([at]), np.array([fp], np.uint16))[0])
        raise Full

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Remove keys that are in the set."""
        for f, a, b in zip(*self._places(hi, lo)):
            for at in (a, b):
                slot = np.flatnonzero(self.table[at] == f)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for few others."""
        fp, one, two = self._places(hi, lo)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<Q", len(self.table)) + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        (n,) = struct.unpack_from("<Q", data)
        return cls(table=np.frombuffer(data, "<u2", n * SLOTS, 8).reshape(n, SLOTS).astype(np.uint16))


def build(hi: np.ndarray, lo: np.ndarray, room: int = 0) -> Cuckoo:
    """A filter of the given keys; a larger one if the first gets too full."""
    n = max(len(hi), room)
    while True:
        made = Cuckoo(n)
        try:
            made.insert(hi, lo)
            return made
        except Full:
            n = 2 * max(n, 1)
