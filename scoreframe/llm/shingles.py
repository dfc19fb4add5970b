"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from scoreframe.llm.common import resident

WIDTH = 5

#: Words whose hashes are kept at hand.
CACHED = 200_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POWERS = [pow(0x9E3779B97F4A7C15, WIDTH - 1 - i, 1 << 64) for i in range(WIDTH)]

#: A-Z to a-z; other bytes stay.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class WordHashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than ASCII white space."""
    return (raw or b"").translate(LOWER).split()


def all_shingles(words: list[bytes]) -> np.ndarray:
    """The hash of each run of WIDTH words, in text order; of fewer words, one hash of them all; of none, none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(resident("word hashes", WordHashes).__getitem__, words)), np.uint64)
    n = len(h) - WIDTH + 1
    if n < 1:  # the number of words takes part, so that this is no other run's hash
        acc = np.uint64(len(words))
        for x in h:
            acc = mix(np.array([acc]) * _STEP + x)[0]
        return np.array([acc], np.uint64)
    acc = np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS):
        acc += h[i : i + n] * np.uint64(p)
    return mix(acc)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(all_shingles(words_of(raw)))
