"""Deep-shallow sorting of suffixes up to a depth, on arrays: all groups of suffixes advance together, a step at a time."""

from __future__ import annotations

import numpy as np

SHALLOW = 2  # words of 8 bytes
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of all keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs, their sizes, and the run of each row."""
    starts = np.flatnonzero(first)
    return starts, np.diff(np.append(starts, len(first))), np.cumsum(first) - 1


class Suffixes:
    """Suffixes data[start:], compared up to depth bytes. data has depth + 8 bytes behind the last start."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int):
        self.words, self.starts, self.depth, self.n_words = words_at(data), starts, depth, -(-depth // 8)
        self.last = _ALL << np.uint64(8 * (8 * self.n_words - depth))

    def word(self, rows: np.ndarray, k) -> np.ndarray:
        """The k-th word of each of rows. k: a number, or one for each."""
        w = self.words[self.starts[rows] + 8 * k]
        return w & np.where(np.asarray(k) == self.n_words - 1, self.last, _ALL)


def _quicksorted(s: Suffixes, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort to SHALLOW words. Each round parts all open runs in three by the word at the run's level: below the pivot (the
    median of three), equal, which goes on to the next level, and above. Returns the order and where its runs begin."""
    begins = _runs(group)
    at, level = np.arange(len(order)), np.zeros(len(order), np.int8)  # places that are open, and their levels
    first = begins.copy()
    shallow = min(SHALLOW, s.n_words)
    while True:
        starts, sizes, run = _of(first)
        open_ = ((sizes > 1) & (level[starts] < shallow))[run] if len(at) else np.zeros(0, bool)
        at, level, first = at[open_], level[open_], first[open_]
        if not len(at):
            return order, begins
        starts, sizes, run = _of(first)
        rows = order[at]
        word = s.word(rows, level)
        a, b, c = (word[x] for x in (starts, starts + sizes // 2, starts + sizes - 1))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        key = 3 * run + side
        moved = np.argsort(key, kind="stable")
        order[at] = rows[moved]
        key, level = key[moved], level[moved] + (side[moved] == 1).astype(np.int8)
        first = _runs(key)
        begins[at[first]] = True


def _blind_tries(s: Suffixes, order: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders what the shallow phase left together, a blind trie for each run: each round lays the path of one suffix, from the root to
    its leaf, in every trie at once, and compares the others with that leaf. Those that agree to the full depth stay in the leaf; the others
    hang at a branching node, known by the length of the common prefix and the byte there alone, and are the run of a trie
    below it. Branches off to smaller bytes come before the leaf, the shallower ones first; those to larger bytes behind it, the deeper ones first."""
    at, first, known = np.arange(len(order)), begins.copy(), min(SHALLOW, s.n_words)
    if known == s.n_words:
        return order, begins
    while True:
        starts, sizes, run = _of(first)
        open_ = (sizes > 1)[run] if len(at) else np.zeros(0, bool)
        at, first = at[open_], first[open_]
        if not len(at):
            return order, begins
        starts, sizes, run = _of(first)
        rows = order[at]
        leaf = rows[starts][run]
        common, byte, above = np.full(len(rows), s.depth), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        left = np.arange(len(rows))
        for k in range(known, s.n_words):
            own, other = s.word(rows[left], k), s.word(leaf[left], k)
            differ = own != other
            hit, bits = left[differ], (own ^ other)[differ]
            place = np.zeros(len(hit), np.int64)
            for width in (32, 16, 8):  # leading bytes in common
                high = bits >> np.uint64(64 - width) == 0
                place += np.where(high, width // 8, 0)
                bits = np.where(high, bits << np.uint64(width), bits)
            common[hit] = 8 * k + place
            byte[hit] = (own[differ] >> (np.uint64(56) - np.uint64(8) * place.astype(np.uint64))).astype(np.int64) & 255
            above[hit] = own[differ] > other[differ]
            left = left[~differ]
        d = s.depth + 1
        branch = np.where(common == s.depth, d, np.where(above, 2 * d - common, common)) * 256 + byte
        key = run * (2 * d + 1) * 256 + branch
        moved = np.argsort(key, kind="stable")
        order[at] = rows[moved]
        key, common = key[moved], common[moved]
        first = _runs(key)
        begins[at[first]] = True
        rest = common < s.depth
        at, first = at[rest], first[rest]


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes data[start:] by group and then by their first depth bytes, and where a run of equal ones of a group begins."""
    group = np.zeros(len(starts), np.int64) if group is None else group
    s = Suffixes(np.concatenate((data, np.zeros(depth + 8, np.uint8))), starts, depth)
    order = np.argsort(group, kind="stable")
    return _blind_tries(s, *_quicksorted(s, order, group[order]))
