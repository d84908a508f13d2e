"""Word hashes and hashes of word windows in numpy, for the duplicate operators.

A word's hash is xxh3 (64 bits); a window's hash is a polynomial of its words' hashes modulo 2**64,
taken from running sums, and mixed.  Everything works on one array for many documents.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


#: Words that a task remembers at once (about 40 MB).
MOST = 1 << 18


class WordHashes(dict):
    """Word to hash; forgets all when it holds ``MOST`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def windows(a: np.ndarray, size: int, base: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` entries at the given starts (all starts by default)."""
    n = len(a)
    if at is None:
        at = np.arange(max(0, n - size + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(a * powers(BASES[base], n), out=sums[1:])
    back = powers(pow(BASES[base], -1, 2**64), n)
    return mix((sums[at + size] - sums[at]) * back[at])
