"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 100_000
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_WORDS = _Hashes()


def shingles(text: str | None, size: int = 4) -> np.ndarray:
    """Distinct shingles of the words between ASCII white space, A-Z lower-cased; with fewer words the whole sequence is the only one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _P
        out += h[i : n - k + 1 + i]
    out = np.sort(mix(out + np.uint64(k)))
    return out if n <= size else out[np.concatenate(([True], out[1:] != out[:-1]))]
