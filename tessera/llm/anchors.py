"""Content-defined anchors: equal strings of a given length have equal anchors, wherever they stand."""

from __future__ import annotations

import numpy as np

#: Bytes whose hash an anchor is.
GRAM = 32
#: Starts of strings that are handled at once.
STRETCH = 1 << 20
_LOW = np.uint64(STRETCH * 2 - 1)
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """For each string of ``length`` bytes in a text, the least hashed gram in it; runs of strings with one gram make an anchor."""

    def __init__(self, length: int):
        self.length = length
        self.width = length - GRAM + 1
        self.up = self.down = np.empty(0, np.uint64)

    def _ready(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the gram, first start, last start) of each run; every start of a string is in one run."""
        return self.marks(data)[:3]

    def marks(self, data: bytes) -> tuple[np.ndarray, ...]:
        """The same with the place of the gram, counted from the first start."""
        found = [self._stretch(data[at : at + STRETCH + self.length - 1], at) for at in range(0, len(data) - self.length + 1, STRETCH)]
        if not found:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _stretch(self, data: bytes, offset: int):
        n = len(data)
        self._ready(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * self.up[:n], out=total[1:])
        grams = (total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        m, w = len(grams), self.width
        keyed = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
        keyed[:m] = (grams & ~_LOW) | np.arange(m, dtype=np.uint64)
        rows = keyed.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = m - w + 1
        at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        return grams[at[first]].view(np.int64), first + offset, last + offset, at[first] - first
