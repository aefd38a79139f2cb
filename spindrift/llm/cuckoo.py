"""Cuckoo filter over 16-byte keys: 16-bit fingerprints, four to a bucket, a stash for leftovers."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200
LOAD = 0.85
_STASH_ROW = 2  # a stashed entry: bucket and fingerprint


def _parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and hash of each key; the first four bytes choose the shard elsewhere."""
    words = np.frombuffer(b"".join(keys), dtype="<u4").reshape(-1, 4) if keys else np.zeros((0, 4), dtype="<u4")
    return (words[:, 1] % 0xFFFF + 1).astype(np.uint16), words[:, 2].astype(np.uint32)


def _jump(fingerprint):
    return fingerprint.astype(np.uint32) * np.uint32(0x5BD1E995) if isinstance(fingerprint, np.ndarray) else (fingerprint * 0x5BD1E995) & 0xFFFFFFFF


class CuckooFilter:
    """Approximate set with deletion; answers for keys that were inserted are never wrong."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * LOAD < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.stash: list[tuple[int, int]] = []

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    def insert(self, keys: list[bytes]) -> None:
        table, mask = self.table, len(self.table) - 1
        for fp, at in zip(*map(np.ndarray.tolist, _parts(keys)), strict=True):
            at &= mask
            for _ in range(KICKS):
                placed = False
                for bucket in (at, (at ^ _jump(fp)) & mask):
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = fp
                        placed = True
                        break
                if placed:
                    break
                at = (at ^ _jump(fp)) & mask
                slot = (fp + at) % SLOTS
                fp, table[at, slot] = int(table[at, slot]), fp
                at = (at ^ _jump(fp)) & mask
            else:
                self.stash.append((at, fp))

    def delete(self, keys: list[bytes]) -> None:
        """Remove keys that were inserted before."""
        table, mask = self.table, len(self.table) - 1
        for fp, at in zip(*map(np.ndarray.tolist, _parts(keys)), strict=True):
            at &= mask
            both = (at, (at ^ _jump(fp)) & mask)
            for bucket in both:
                held = np.flatnonzero(table[bucket] == fp)
                if len(held):
                    table[bucket, held[0]] = 0
                    break
            else:
                self.stash.remove(next(s for s in self.stash if s[1] == fp and s[0] in both))

    def contains(self, keys: list[bytes]) -> np.ndarray:
        fp, at = _parts(keys)
        mask = np.uint32(len(self.table) - 1)
        one = at & mask
        two = (one ^ _jump(fp)) & mask
        found = (self.table[one] == fp[:, None]).any(axis=1) | (self.table[two] == fp[:, None]).any(axis=1)
        for bucket, stashed in self.stash:
            found |= (fp == stashed) & ((one == bucket) | (two == bucket))
        return found

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, dtype="<u4").reshape(-1, _STASH_ROW)
        return np.array([len(self.table)], dtype="<u4").tobytes() + self.table.astype("<u2").tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        buckets = int(np.frombuffer(data, dtype="<u4", count=1)[0])
        out.table = np.frombuffer(data, dtype="<u2", count=buckets * SLOTS, offset=4).reshape(buckets, SLOTS).copy()
        out.stash = [tuple(map(int, r)) for r in np.frombuffer(data, dtype="<u4", offset=4 + buckets * SLOTS * 2).reshape(-1, _STASH_ROW)]
        return out
