"""A cuckoo filter over 32-byte digests that keeps its keys: what one shard of an index holds.

Each digest has a 16-bit print and two buckets of four slots, either of which follows from the
other and the print. A slot holds the print and the number of its key in the store beside it, so
a hit is settled by the key itself, a deletion frees exactly the slot of its key, and a table
that overflows is made anew at twice the size from the stored keys.
"""

from __future__ import annotations

import numpy as np

DIGEST = 32
SLOTS = 4
#: Evictions after which an insertion counts as an overflow.
KICKS = 256
#: Share of the slots that a new table is meant to fill.
LOAD = 0.8


def as_digests(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, DIGEST)


def as_keys(digests: np.ndarray) -> np.ndarray:
    """One comparable value for each digest."""
    return np.ascontiguousarray(digests).view(f"V{DIGEST}").ravel()


def prints(digests: np.ndarray) -> np.ndarray:
    """The print of each digest, never 0, which marks a free slot."""
    found = digests[:, 0].astype(np.int64) | digests[:, 1].astype(np.int64) << 8
    return np.where(found == 0, 1, found)


def first_places(digests: np.ndarray) -> np.ndarray:
    return sum(digests[:, 2 + i].astype(np.int64) << 8 * i for i in range(5))


def step(prints_: np.ndarray) -> np.ndarray:
    """What the numbers of a print's two buckets differ by, bit by bit."""
    return prints_ * 0x5BD1E995 + 0x3C6EF372 >> 3


def buckets_for(n: int) -> int:
    size = 1
    while size * SLOTS * LOAD < n:
        size *= 2
    return size


class CuckooFilter:
    """Live digests with the number of documents of each; digests that repeat are one key."""

    def __init__(self, expected: int = 0):
        self.digests = np.empty((0, DIGEST), np.uint8)
        self.counts = np.empty(0, np.int64)
        self.resized = 0
        self._clear(buckets_for(expected))

    def _clear(self, buckets: int) -> None:
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.keys = np.full((buckets, SLOTS), -1, np.int32)

    def __len__(self) -> int:
        return int((self.counts > 0).sum())

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, mask = prints(digests), len(self.prints) - 1
        one = first_places(digests) & mask
        return found, one, (one ^ step(found)) & mask

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        """False for digests that are certainly not live; from the prints alone."""
        found, one, other = self._places(digests)
        return (self.prints[one] == found[:, None]).any(1) | (self.prints[other] == found[:, None]).any(1)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Number of each digest's key, -1 where it is not live. Every hit of a print is held against its key."""
        found, one, other = self._places(digests)
        out = np.full(len(digests), -1, np.int64)
        for places in (one, other):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[places, slot] == found) & (out < 0))
                key = self.keys[places[hit], slot]
                same = (self.digests[key] == digests[hit]).all(1)
                out[hit[same]] = key[same]
        return out

    def insert(self, digests: np.ndarray, counts: np.ndarray) -> None:
        """Adds documents: to the counts of digests that are live, or as new keys."""
        if not len(digests):
            return
        keys, back = np.unique(as_keys(digests), return_inverse=True)
        digests, counts = keys.view(np.uint8).reshape(-1, DIGEST), np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
        at = self.find(digests)
        live = at >= 0
        self.counts[at[live]] += counts[live]
        first = len(self.counts)
        self.digests = np.concatenate([self.digests, digests[~live]])
        self.counts = np.concatenate([self.counts, counts[~live]])
        if not self._place(np.arange(first, len(self.counts))):
            self.resize()

    def _place(self, keys: np.ndarray) -> bool:
        """Puts keys of the store into slots; False if one finds none."""
        found, one, other = self._places(self.digests[keys])
        left = np.arange(len(keys))
        for places in (one, other):
            for slot in range(SLOTS):
                free = left[self.prints[places[left], slot] == 0]
                _, first = np.unique(places[free], return_index=True)
                chosen = free[first]
                self.prints[places[chosen], slot] = found[chosen]
                self.keys[places[chosen], slot] = keys[chosen]
                left = np.setdiff1d(left, chosen, assume_unique=True)
        return all(self._kick(int(found[i]), int(keys[i]), int(other[i])) for i in left)

    def _kick(self, print_: int, key: int, place: int) -> bool:
        """Puts a key into its bucket and moves what it evicts to the other bucket of that, and so on."""
        mask = len(self.prints) - 1
        for turn in range(KICKS):
            free = np.flatnonzero(self.prints[place] == 0)
            slot = int(free[0]) if len(free) else (turn + key) % SLOTS
            out = int(self.prints[place, slot]), int(self.keys[place, slot])
            self.prints[place, slot], self.keys[place, slot] = print_, key
            if len(free):
                return True
            print_, key = out
            place = (place ^ int(step(np.int64(print_)))) & mask
        return False

    def delete(self, digests: np.ndarray, counts: np.ndarray) -> None:
        """Takes documents away; a digest without any is no longer live. One that is not live, or has fewer, fails."""
        if not len(digests):
            return
        keys, back = np.unique(as_keys(digests), return_inverse=True)
        digests, counts = keys.view(np.uint8).reshape(-1, DIGEST), np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
        at = self.find(digests)
        if (at < 0).any() or (self.counts[at] < counts).any():
            raise ValueError("a digest to delete is not live")
        self.counts[at] -= counts
        gone = at[self.counts[at] == 0]
        _, one, other = self._places(self.digests[gone])
        for places in (one, other):
            for slot in range(SLOTS):
                own = self.keys[places, slot] == gone
                self.prints[places[own], slot] = 0
                self.keys[places[own], slot] = -1

    def resize(self) -> None:
        """A table for the live keys, made from the store; twice the size as long as they do not fit."""
        live = self.counts > 0
        self.digests, self.counts = self.digests[live], self.counts[live]
        size = buckets_for(len(self.counts))
        while True:
            self.resized += 1
            self._clear(size)
            if self._place(np.arange(len(self.counts))):
                return
            size *= 2

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.prints.tobytes(), self.keys.tobytes(), self.digests.tobytes(), self.counts.tobytes()

    @classmethod
    def from_row(cls, prints_: bytes, keys: bytes, digests: bytes, counts: bytes) -> CuckooFilter:
        self = cls()
        self.prints = np.frombuffer(prints_, np.uint16).reshape(-1, SLOTS).copy()
        self.keys = np.frombuffer(keys, np.int32).reshape(-1, SLOTS).copy()
        self.digests, self.counts = as_digests(digests).copy(), np.frombuffer(counts, np.int64).copy()
        return self
