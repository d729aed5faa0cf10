"""The best rows of each of many queries, kept in a task of bounded size while rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells (queries times rows) that a task scores at once.
CELLS = 1 << 20


class Best:
    """The k best rows (score, then smaller index) of each of n queries. NaN is the largest score, as in SQL."""

    def __init__(self, n: int, k: int):
        self.k = max(k, 0)
        self.score = np.full((n, self.k), -np.inf)
        self.index = np.zeros((n, self.k), dtype=np.int64)
        self.name = np.full((n, self.k), None, dtype=object)
        self.full = np.zeros((n, self.k), dtype=bool)

    def add(self, at: int, score: np.ndarray, index: np.ndarray, name: np.ndarray, digits: int | None = None) -> None:
        """New rows: score has a line for each query from `at` on and a column for each row. With `digits`, scores that
        are equal to so many places are equals. A score of -inf is no hit."""
        if not self.k or not score.size:
            return
        mine = slice(at, at + len(score))
        key = _key(score, digits)
        floor = np.where(self.full[mine, -1], _key(self.score[mine, -1], digits), -np.inf)
        if self.k < key.shape[1]:
            floor = np.maximum(floor, np.partition(key, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((key >= floor[:, None]) & (key > -np.inf))
        if not len(q):
            return
        some = np.unique(q)
        old = self.full[mine][some]
        held = lambda x: x[mine][some][old]
        of = np.concatenate([np.repeat(some, old.sum(axis=1)), q])
        score, index, name = (np.concatenate([held(a), b]) for a, b in ((self.score, score[q, r]), (self.index, index[r]), (self.name, name[r])))
        order = np.lexsort((index, -_key(score, digits), of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        to, order = (of[keep] + at, place[keep]), order[keep]
        self.score[to], self.index[to], self.name[to], self.full[to] = score[order], index[order], name[order], True

    def rows(self, ids: list, schema: pa.Schema, lines: int = 4096) -> Iterator[pa.RecordBatch]:
        """(query's id, row's id, index, score) of all that is held."""
        for i in range(0, len(ids), lines):
            q, at = np.nonzero(self.full[i : i + lines])
            if len(q):
                q += i
                columns = ([ids[x] for x in q], self.name[q, at].tolist(), self.index[q, at], self.score[q, at])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _key(score: np.ndarray, digits: int | None) -> np.ndarray:
    return np.where(np.isnan(score), np.inf, score if digits is None else np.round(score, digits))
