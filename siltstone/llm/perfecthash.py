"""A minimal perfect hash over a fixed set of 64-bit keys: hash, displace, and no slot is left empty."""

from __future__ import annotations

import numpy as np

from siltstone.llm.arrowtext import mix

#: Keys of a bucket, on average, and displacements tried at once.
LOAD, TRIED = 4, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Slots 0 to n - 1 of n different keys.  A key outside the set gets some slot: the caller compares what stands there."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys repeat")
        self.n, self.shift = n, np.zeros(max(1, n // LOAD), np.uint64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=len(self.shift))
        starts = np.cumsum(counts) - counts
        free = np.ones(n, bool)
        for b in np.argsort(-counts, kind="stable").tolist():  # the fullest buckets first, while there is room
            mine = keys[order[starts[b] : starts[b] + counts[b]]]
            if not len(mine):
                break
            shift = 0
            while True:
                slots = self._slots(mine[None, :], np.arange(shift, shift + TRIED, dtype=np.uint64)[:, None])
                good = free[slots].all(axis=1)
                if len(mine) > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    self.shift[b], free[slots[at]] = shift + at, False
                    break
                shift += TRIED

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) % np.uint64(len(self.shift))).astype(np.int64)

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + (shift + np.uint64(1)) * _STEP) % np.uint64(max(self.n, 1))).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return self._slots(keys, self.shift[self._bucket(keys)])
