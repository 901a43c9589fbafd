"""Word-shingle sets of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MEMO_MOST = 150_000
_ODD = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """Word -> 64-bit hash; bounded, kept per Python worker."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MEMO_MOST:
            self[word] = h
        return h


_hash_of = _WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; fewer words are one shingle, none are none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return mixed((h * _ODD[: len(h)]).sum(keepdims=True) + np.full(1, len(h), np.uint64) * _ODD[63])
    m = len(h) - n + 1
    total = h[:m] * _ODD[0]
    for i in range(1, n):
        total = total + h[i : i + m] * _ODD[i]
    return np.unique(mixed(total))
