"""Affine-gap alignment of two sequences, for Arrow batches: one row aligns one pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 1.0, -1.0, -3.0, -1.0


def align(a: str, b: str, local: bool = False, match: float = MATCH, mismatch: float = MISMATCH, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> tuple[float, str, int, int]:
    """Best score, its code (M, I: only in b, D: only in a) and where it begins in a and b.

    A gap of k bases costs gap_open + k * gap_extend. Rows are vectors; the running best of gaps in b, which
    depends on its left neighbour, is a maximum over the row after removing the cost of extension.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.upper().encode("latin-1", "replace"), np.uint8), np.frombuffer(b.upper().encode("latin-1", "replace"), np.uint8)
    low = -1e18
    slope = gap_extend * np.arange(m + 1)
    best = np.full(m + 1, low)
    best[0] = 0.0
    down = np.full(m + 1, low)
    best[1:] = 0.0 if local else gap_open + slope[1:]
    # How each cell was reached: 0 diagonal, 1 left, 2 up, 3 start; and whether a gap goes on.
    move = np.zeros((n + 1, m + 1), np.uint8)
    longer_up = np.zeros((n + 1, m + 1), bool)
    width = np.zeros((n + 1, m + 1), np.int64)
    move[0, 1:], width[0] = (3 if local else 1), np.arange(m + 1)
    top = (best.max() if local else low, 0, 0)
    for i in range(1, n + 1):
        open_, goes = best + gap_open + gap_extend, down + gap_extend
        longer_up[i] = goes > open_
        down = np.maximum(open_, goes)
        cell = down.copy()
        diagonal = best[:-1] + np.where(y == x[i - 1], match, mismatch)
        cell[1:] = np.maximum(cell[1:], diagonal)
        if local:
            cell = np.maximum(cell, 0.0)
        reach = np.maximum.accumulate(cell - slope)
        at = np.maximum.accumulate(np.where(cell - slope >= reach, np.arange(m + 1), 0))
        left = np.full(m + 1, low)
        left[1:] = reach[:-1] + slope[1:] + gap_open
        row = np.maximum(cell, left)
        kind = np.full(m + 1, 2, np.uint8)
        kind[1:][diagonal >= down[1:]] = 0
        if local:
            kind[row <= 0] = 3
        sideways = left > cell
        kind[sideways] = 1
        width[i, 1:] = np.arange(1, m + 1) - at[:-1]
        move[i], best = kind, row
        if local and row.max() > top[0]:
            top = (float(row.max()), i, int(row.argmax()))
    score, i, j = top if local else (float(best[m]), n, m)
    ops: list[tuple[int, str]] = []
    while (i or j) and not (local and move[i, j] == 3):
        if i and j and move[i, j] == 0:
            ops.append((1, "M"))
            i, j = i - 1, j - 1
        elif j and (move[i, j] == 1 or i == 0):
            k = int(width[i, j])
            ops.append((k, "I"))
            j -= k
        else:
            k = 1
            while i - k > 0 and longer_up[i - k + 1, j]:
                k += 1
            ops.append((k, "D"))
            i -= k
    code: list[list] = []
    for k, op in reversed(ops):
        if code and code[-1][1] == op:
            code[-1][0] += k
        else:
            code.append([k, op])
    return score, "".join(f"{k}{op}" for k, op in code), i, j


def align_columns(a: Column, b: Column, local: bool = False) -> Column:
    """Struct score, cigar, a_start, b_start for each pair; equal pairs of a batch are aligned once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            both = [(x or "", y or "") for x, y in zip(left, right, strict=True)]
            found = {pair: align(*pair, local) for pair in dict.fromkeys(both)}
            yield pd.DataFrame([found[pair] for pair in both], columns=["score", "cigar", "a_start", "b_start"])

    return F.pandas_udf(run, "score double, cigar string, a_start long, b_start long")(a, b)
