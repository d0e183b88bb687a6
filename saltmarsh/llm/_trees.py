"""Scores of texts under frozen context trees of bytes, looked up for a whole array of positions at a time."""

from __future__ import annotations

import numpy as np

from saltmarsh.llm import _vec


class Scorer:
    """Sums of per-byte values of several models.

    ``steps[k]`` is for the k-th longest context: the keys of (context, next byte), their values (n, models), the keys of
    contexts, and what leaving the context for a shorter one adds, (m, models). A byte is looked up with the longest
    context first; where the pair isn't there, it leaves that context (if known at all) and tries the next.
    """

    def __init__(self, steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], unknown: np.ndarray, pad: int):
        self.depth, self.unknown, self.pad = len(steps) - 1, unknown, pad
        self.steps = [(_vec.Slots(keys), values, _vec.Slots(contexts), leave) for keys, values, contexts, leave in steps]

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row the sums of its bytes' values, (rows, models)."""
        return _vec.row_sums(self.each(data, offsets), offsets)

    def each(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Every byte's values, (bytes, models); contexts don't reach before a row's start."""
        whole = _vec.grams(data, offsets, self.depth + 1, self.pad)
        out = np.zeros((len(data), len(self.unknown)), np.float32)
        todo = np.arange(len(data))
        for k, (pairs, values, contexts, leave) in enumerate(self.steps):
            width = self.depth + 1 - k
            keys = whole & np.uint64((1 << (8 * width)) - 1)
            row = pairs.find(keys)
            hit = row >= 0
            if k == 0:
                out[hit] = values[row[hit]]
                lost = np.flatnonzero(~hit)
            else:
                out[todo[hit]] += values[row[hit]]
                lost = np.flatnonzero(~hit)
            todo, whole = todo[lost], whole[lost]
            context = contexts.find(keys[lost] >> np.uint64(8))
            known = context >= 0
            out[todo[known]] += leave[context[known]]
        out[todo] += self.unknown
        return out
