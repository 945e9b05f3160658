"""Token ids of texts through their distinct units: each unit is encoded once and looked up after that."""

from __future__ import annotations

import itertools

import numpy as np

from recollect.llm import flat

LIMIT = 600_000  # units that a memory holds, about 180 bytes each


class Units:
    """Ids of units met so far. `encode` takes a list of distinct strings and returns their ids, one
    after the other, and how many each has. Beyond `limit` units the memory starts anew."""

    def __init__(self, encode, limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)

    def ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and the number of ids of each."""
        if len(self.index) > self.limit:
            self.clear()
        k = np.fromiter(map(self.index.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            k[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        starts = self.at[k]
        counts = self.at[k + 1] - starts
        return self.ids[flat.spread(starts, counts)], counts

    def _learn(self, new: list[str]):
        ids, counts = self.encode(new)
        n, used = len(self.index), int(self.at[len(self.index)])
        self.ids = _room(self.ids, used + len(ids))
        self.ids[used:used + len(ids)] = ids
        self.at = _room(self.at, n + len(new) + 1)
        self.at[n + 1:n + len(new) + 1] = used + np.cumsum(counts)
        self.index.update(zip(new, range(n, n + len(new))))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[:len(array)] = array
    return out


def per_text(counts: np.ndarray, units: list[int]) -> np.ndarray:
    """Where the ids of each text begin, from the ids of each unit and the units of each text."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    return ends[np.concatenate([[0], np.cumsum(units)]).astype(np.int64)]
