"""Rolling hashes of byte strings as numpy arrays.

``prefix[i]`` is a sum of random values of the first i bytes, each times a power
of an odd base, modulo 2**64; the value of any substring follows from two of them.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse up to ``n``."""
    global _powers, _inverses
    if len(_powers) >= n:
        return
    size = max(n, 2 * len(_powers), 1 << 16)
    for name, base in (("_powers", BASE), ("_inverses", pow(BASE, -1, 1 << 64))):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        globals()[name] = np.multiply.accumulate(steps)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can serve as a hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of substrings of one byte string, or of stretches of 64-bit values."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        _grow(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((_VALUES[data] if data.dtype == np.uint8 else data) * _powers[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal strings have equal hashes."""
        return mix((self.prefix[end] - self.prefix[start]) * _inverses[start] + (end - start).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        """Hash of every substring of ``q`` bytes, by start."""
        n = len(self.prefix) - q
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[q:] - self.prefix[:n]) * _inverses[:n] + np.uint64(q))
