"""Cuckoo filter over 128-bit keys: membership, insertion and deletion in a fixed number of 16-bit slots.

Each key has two buckets of SLOTS fingerprints. Insertion moves fingerprints between their two buckets until one finds
room; a filter that has no room left is rebuilt at twice its size by whoever holds the exact keys. A key that was inserted is
always found; another one is found with a chance of about 2 * SLOTS / 65,536 at most. Only inserted keys may be deleted.
"""

from __future__ import annotations

import numpy as np

from descria.llm.words import mix

SLOTS = 4
MOST_MOVES = 500
#: Share of slots that a new filter is planned to fill.
LOAD = 0.75


def key_words(keys: list[bytes]) -> np.ndarray:
    """16-byte keys as rows of two unsigned 64-bit integers."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2).astype(np.uint64)


class CuckooFilter:
    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for about ``keys`` keys."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter with all ``keys`` (two words each), as large as they need."""
        room = len(keys)
        while True:
            made = cls.sized(room)
            if made.insert(keys):
                return made
            room = max(1, room) * 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").astype(np.uint16).reshape(-1, SLOTS))

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of each key."""
        mark = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = keys[:, 1] & self.mask
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a fingerprint to the other, and back."""
        return mix(mark.astype(np.uint64)) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        found = (self.slots[first] == mark[:, None]).any(1)
        return found | (self.slots[second] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Puts keys in; False if one found no room, after which the filter must be rebuilt."""
        if not len(keys):
            return True
        marks, firsts, seconds = self._places(keys)
        table = self.slots
        for mark, first, second in zip(marks.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
            for bucket in (first, second):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = mark
                    break
            else:
                bucket = second
                for move in range(MOST_MOVES):
                    slot = move % SLOTS
                    mark, table[bucket, slot] = int(table[bucket, slot]), mark
                    bucket = bucket ^ int(self._jump(np.array([mark], np.uint16))[0])
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes keys out that were inserted before."""
        marks, firsts, seconds = self._places(keys)
        for mark, first, second in zip(marks.tolist(), firsts.tolist(), seconds.tolist(), strict=True):
            for bucket in (first, second):
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break
            else:
                raise ValueError("a key to delete was never inserted")
