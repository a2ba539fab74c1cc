"""Positions that texts sharing 50 bytes agree on: minimizers of byte q-grams."""

from __future__ import annotations

import numpy as np

from brindle.llm.shingles import mix

MATCH, GRAM = 50, 22
SPAN = MATCH - GRAM + 1  # q-grams that begin in a string of MATCH bytes and end in it
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def summed(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def hashes(total: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the size bytes from each position on, where there are as many."""
    n = len(total) - 1
    return mix((total[size:] - total[: n - size + 1]) * _powers(n + 1)[1][: n - size + 1]) if n >= size else np.zeros(0, np.uint64)


def contexts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: position, hash, a hash of its context, and the context's length. The context is all strings of MATCH bytes that contain
    the anchor: up to SPAN - 1 bytes before its position and MATCH from there on, as the text has them."""
    total = summed(data)
    at, h = anchors(data, total)
    if not len(at):
        return at, h, h, at
    down = _powers(len(data) + 1)[1]
    start, end = np.maximum(at - SPAN + 1, 0), np.minimum(at + MATCH, len(data))
    c = mix((total[end] - total[start]) * down[start] ^ (h * np.uint64(3)))
    return at, h, mix(c + ((at - start) * 128 + end - start).astype(np.uint64)), end - start


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each width consecutive entries."""
    n = len(x)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if op is np.minimum else np.uint64(0)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and q-gram hashes of a text's minimizers: every string of MATCH bytes contains one, at a place in it that
    depends on the string alone. Ties are all taken."""
    if len(data) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes(total, GRAM)
    least = _sliding(h, SPAN, np.minimum)
    around = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)))
    at = np.flatnonzero(_sliding(around, SPAN, np.maximum) == h)
    return at, h[at]
