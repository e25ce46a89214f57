"""Cuckoo filters (four 16-bit fingerprints a bucket) with bulk operations in numpy."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Share of a filter's slots that is filled before a further one of the same size is added.
LOAD = 0.85
_ROUNDS = 400


def key_parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, fingerprint) of each key (rows of two uint64)."""
    fp = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
    fp[fp == 0] = 1  # 0 marks a free slot
    return (keys[:, 0] & np.uint64(buckets - 1)).astype(np.int64), fp


def other_bucket(at: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
    """The second bucket of a fingerprint that stands in bucket ``at``; its own inverse."""
    return at ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & (buckets - 1))


class CuckooFilter:
    """Holds one fingerprint per key inserted. Filters of one chain have the same number of
    buckets, so that equal fingerprints are interchangeable and removing one is safe."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.used = (self.slots != 0).sum(axis=1)  # filled slots stand first

    def __len__(self) -> int:
        return int(self.used.sum())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, fp = key_parts(keys, self.buckets)
        alt = other_bucket(at, fp, self.buckets)
        return ((self.slots[at] == fp[:, None]) | (self.slots[alt] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inserts all keys; returns (bucket, fingerprint) of those that found no slot."""
        return self.place(*key_parts(keys, self.buckets))

    def place(self, at: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for turn in range(_ROUNDS):
            if not len(at):
                break
            order = np.argsort(at, kind="stable")
            at, fp = at[order], fp[order]
            n = np.arange(len(at))
            first = np.concatenate([[True], at[1:] != at[:-1]])
            slot = self.used[at] + n - np.maximum.accumulate(np.where(first, n, 0))
            fits = slot < SLOTS
            self.slots[at[fits], slot[fits]] = fp[fits]
            np.add.at(self.used, at[fits], 1)
            at, fp = at[~fits], fp[~fits]
            if turn and len(at):  # one waiting fingerprint of each full bucket takes another's slot
                _, one = np.unique(at, return_index=True)
                victim = self.slots[at[one], turn % SLOTS].copy()
                self.slots[at[one], turn % SLOTS] = fp[one]
                fp[one] = victim
            at = other_bucket(at, fp, self.buckets)
        return at, fp

    def remove(self, at: int, fp: int) -> bool:
        """Removes one copy of a fingerprint from its two buckets."""
        alt = int(other_bucket(np.array([at]), np.array([fp], np.uint16), self.buckets)[0])
        for b in (at, alt):
            where = np.flatnonzero(self.slots[b] == fp)
            if len(where):
                last = self.used[b] - 1
                self.slots[b, where[0]] = self.slots[b, last]
                self.slots[b, last] = 0
                self.used[b] = last
                return True
        return False


class Chain:
    """The filters of one shard; grows by filters of equal size."""

    def __init__(self, buckets: int, blobs: list[bytes]):
        self.buckets = buckets
        self.filters = [CuckooFilter(buckets, np.frombuffer(b, np.uint16).reshape(buckets, SLOTS).copy())
                        for b in blobs]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for f in self.filters:
            out |= f.contains(keys)
        return out

    def insert(self, keys: np.ndarray) -> None:
        at, fp = key_parts(keys, self.buckets)
        place = 0
        while len(at):
            if place == len(self.filters):
                self.filters.append(CuckooFilter(self.buckets))
            f = self.filters[place]
            room = max(int(LOAD * SLOTS * self.buckets) - len(f), 0)
            left = f.place(at[:room], fp[:room])
            at, fp = np.concatenate([left[0], at[room:]]), np.concatenate([left[1], fp[room:]])
            place += 1

    def delete(self, keys: np.ndarray) -> None:
        for at, fp in zip(*(x.tolist() for x in key_parts(keys, self.buckets))):
            if not any(f.remove(at, fp) for f in self.filters):
                raise ValueError("a key to delete is in no filter of its shard")

    def blobs(self) -> list[bytes]:
        return [f.slots.tobytes() for f in self.filters]
