"""Words of a text as 64-bit hashes, for use inside Python workers."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

MAX_WORDS = 128_000  # entries of a dictionary that a Python worker keeps, some 25 MB
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word (bytes) to 64-bit hash; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@cache
def _hashes() -> Hashes:
    return Hashes()


def hashes(data: bytes) -> np.ndarray:
    """One hash per word; words are runs of bytes other than space and 0x09-0x0D."""
    words = data.split()
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def multiple(n: int) -> np.uint64:
    """``n`` times a fixed odd number, modulo 2**64; odd for odd ``n``."""
    return np.uint64(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64 bits as a fraction in [0, 1)."""
    return (x >> np.uint64(11)) * 2.0**-53


def shingles(data: bytes, width: int) -> np.ndarray:
    """A hash per window of ``width`` words; a shorter text is one window, an empty one none."""
    h = hashes(data)
    if not len(h):
        return h
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * multiple(2 * k + 1)
    return mix(total + np.uint64(width))


def lots(batches, rows: int = 1000):
    """The batches in lots of so many rows: what is made of a batch need not be held all at once."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]
