"""The k best of each question among the rows that a task sees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """Holds the k best rows of each question in each group; equal scores go in order of name. What a task holds is bounded by groups, questions and k."""

    def __init__(self, k: int, questions: int):
        self.k, self.n, self.held = k, questions, {}

    def add(self, group, names: pa.Array, scores: np.ndarray, of: np.ndarray | None = None) -> None:
        """scores: a row for each of names, a column for each question, -inf where it is no result; of: the numbers of these questions, all by default."""
        n, q = scores.shape
        if not n or not q:
            return
        of = np.arange(q) if of is None else of
        state = self.held.setdefault(group, [np.full(self.n, -np.inf), [], 0])
        least = state[0][of]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k])
        at, column = np.nonzero((scores >= least) & (scores > -np.inf))
        if len(at):
            state[1].append((of[column], names.take(pa.array(at)).to_numpy(zero_copy_only=False), scores[at, column]))
            state[2] += len(at)
            if state[2] > 4 * self.k * len(of) + 1000:
                self._prune(state)

    def _prune(self, state: list) -> None:
        of, names, scores = (np.concatenate(x) for x in zip(*state[1], strict=True))
        order = np.argsort(names, kind="stable")
        order = order[np.lexsort((-scores[order], of[order]))]
        of, names, scores = of[order], names[order], scores[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        state[0][of[place == self.k - 1]] = scores[place == self.k - 1]
        kept = place < self.k
        state[1] = [(of[kept], names[kept], scores[kept])]
        state[2] = int(kept.sum())

    def rows(self):
        """(group, numbers of questions, names, scores) of what is held."""
        for group, state in self.held.items():
            if state[1]:
                self._prune(state)
                yield group, *state[1][0]
