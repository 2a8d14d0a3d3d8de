"""Sequences of unequal length laid out step by step, so that a recursion over them is one array operation a step."""

from __future__ import annotations

import numpy as np


class Packed:
    """``order``: the sequences from long to short; rows off[t]:off[t] + active[t] hold step t of the sequences longer than t."""

    def __init__(self, bounds: np.ndarray):
        size = np.diff(bounds)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.size = size
        steps = int(size[0]) if len(size) else 0
        self.active = np.searchsorted(-size, -np.arange(steps), "left") if steps else np.zeros(0, np.int64)
        self.off = np.r_[0, np.cumsum(self.active)].astype(np.int64)
        rank = np.empty(len(size), np.int64)
        rank[self.order] = np.arange(len(size))
        lengths = np.diff(bounds)
        step = np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], lengths)
        #: place[k] is where element k of the flat sequences stands.
        self.place = self.off[step] + np.repeat(rank, lengths) if len(step) else step

    def pack(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.place] = flat
        return out
