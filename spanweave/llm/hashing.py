"""Hashes of substrings by prefix sums of powers modulo 2^64. They only find candidates: whoever uses them compares the characters, as equal hashes can be made."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_LEAST = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Hashes that do not depend on where a substring stands."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)
        self.mixed = np.zeros(0, np.uint64)

    def take(self, chars: np.ndarray) -> None:
        n = len(chars)
        if not len(self.mixed):
            self.mixed = mix(np.arange(0x110000, dtype=np.uint64))
        if n + 1 > len(self.power):
            size = max(n, _LEAST) + 1
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.mixed[chars] * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        """The hash at every place that ``size`` characters follow."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])
