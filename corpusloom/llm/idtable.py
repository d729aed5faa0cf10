"""A growing table of the ids of pieces of text, for encoders that remember what they have encoded."""

from __future__ import annotations

import numpy as np


class IdTable:
    """Ids of pieces one after the other, and where each piece's begin; a piece is known by its row."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.at, self.rows = np.zeros(1 << 18, dtype=np.int64), 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Put the ids of new pieces behind the others; their rows."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.rows + len(sizes) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        first = self.rows
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first + 1 : first + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.rows = self.used + len(ids), first + len(sizes)
        return range(first, self.rows)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces one after the other, number of ids of each)."""
        starts, sizes = self.at[rows], self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        where = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return self.ids[where], sizes

    def joined(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of runs of pieces: counts has the number of pieces of each run."""
        ids, sizes = self.gather(rows)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return ids, np.diff(ends)
