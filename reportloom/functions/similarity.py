"""Ratcliff-Obershelp similarity: the longest block that two texts share, then the same left and right of it, until nothing is shared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this length of the second text on, characters that make up more than 1 % of it (and one) begin no block. Fixed values.
LONG, SHARE = 200, 100
#: Numbers of a table of runs; larger ones are made row by row, as often as blocks are searched.
TABLE = 1 << 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _begins(b: np.ndarray) -> np.ndarray:
    """Which characters of the second text may begin a block."""
    if len(b) < LONG:
        return np.ones(len(b), bool)
    _, back, counts = np.unique(b, return_inverse=True, return_counts=True)
    return (counts <= len(b) // SHARE + 1)[back]


class _Runs:
    """Lengths of the common runs that end at each place of either text, from a given corner on."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, self.usable = a, b, _begins(b)
        self.table = self._all() if a.size * b.size <= TABLE else None

    def _row(self, i: int, before: np.ndarray, blo: int, bhi: int) -> np.ndarray:
        row = np.zeros(bhi - blo, np.int32)
        row[1:] = before[:-1]
        row += 1
        row *= (self.b[blo:bhi] == self.a[i]) & self.usable[blo:bhi]
        return row

    def _all(self) -> np.ndarray:
        out = np.zeros((len(self.a), len(self.b)), np.int32)
        row = np.zeros(len(self.b), np.int32)
        for i in range(len(self.a)):
            row = out[i] = self._row(i, row, 0, len(self.b))
        return out

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest run within the bounds; of equals the first in the first text, then in the second."""
        size, end_i, end_j = 0, alo, blo
        if self.table is not None:
            part = self.table[alo:ahi, blo:bhi]
            part = np.minimum(np.minimum(part, np.arange(1, ahi - alo + 1, dtype=np.int32)[:, None]), np.arange(1, bhi - blo + 1, dtype=np.int32)[None, :])
            at = int(part.argmax())
            end_i, end_j = alo + at // (bhi - blo), blo + at % (bhi - blo)
            size = int(part.flat[at])
        else:
            row = np.zeros(bhi - blo, np.int32)
            for i in range(alo, ahi):
                row = self._row(i, row, blo, bhi)
                j = int(row.argmax())
                if row[j] > size:
                    size, end_i, end_j = int(row[j]), i, blo + j
        i, j = (end_i - size + 1, end_j - size + 1) if size else (alo, blo)
        # characters that begin no block still lengthen one
        while i > alo and j > blo and self.a[i - 1] == self.b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and self.a[i + size] == self.b[j + size]:
            size += 1
        return i, j, size


def shared(a: str, b: str) -> int:
    """Characters in the blocks that two texts share."""
    x, y = _codes(a), _codes(b)
    runs, total, todo = _Runs(x, y), 0, [(0, len(x), 0, len(y))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo < ahi and blo < bhi:
            i, j, size = runs.longest(alo, ahi, blo, bhi)
            if size:
                total += size
                todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Twice the shared characters by all characters; 1 for two empty texts, 0 for one. Null is empty."""
    a, b = a or "", b or ""
    if not a or not b:
        return float(a == b)
    return 1.0 if a == b and len(b) < LONG else 2.0 * shared(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of each pair; memory is bounded by the table of runs or one row of it."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
