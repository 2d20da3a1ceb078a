"""Words as small integers and 64-bit hashes, for workers that handle texts in bulk.

A word is a run of bytes other than the six ASCII white-space bytes; on bytes, split()
parts at exactly these, and lower() changes exactly A-Z.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

_HELD: dict[str, object] = {}


def held(name: str, make):
    """What a worker keeps from task to task: one thing at a time, so that operators do not add up."""
    if name not in _HELD:
        drop_held()
        _HELD[name] = make()
    return _HELD[name]


def drop_held() -> None:
    """Called by tasks of operators that keep nothing, before they build their own tables."""
    _HELD.clear()
    give_back()


def give_back() -> None:
    """Return what is free to the system.

    An executor may have more workers than cores, as one that ends its task is replaced before it
    is idle: what idle ones hold is missing to the others.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def resting(run):
    """``run``, for mapInArrow, as a task that gives back at its end what it has freed."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


#: Words that a worker keeps before it starts anew.  A cache: no result depends on it.
CACHE_WORDS = 300_000

#: Odd multipliers of the places in a shingle.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(1, 65)], dtype=np.uint64)


class WordIndex(dict):
    """word -> index; ``hashes()[index]`` is the word's 64-bit hash."""

    def __init__(self) -> None:
        drop_held()
        super().__init__()
        self._hashes = np.empty(1 << 16, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.empty(n, dtype=np.uint64)])
        self._hashes[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n

    def indexes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def hashes(self) -> np.ndarray:
        return self._hashes

    def hashed(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        at = self.indexes(words)
        return self._hashes[at]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words; of the whole where there are fewer, none of none."""
    n = len(hashed)
    if not n:
        return hashed
    size = min(width, n)
    out = hashed[: n - size + 1] * _PLACES[0]
    for k in range(1, size):
        out = out + hashed[k : n - size + 1 + k] * _PLACES[k]
    return mix(out + np.uint64(size))
