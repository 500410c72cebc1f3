"""Local alignment of word sequences inside a band, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1
SMALL = 1 << 22              # cells of a table that is kept whole


@dataclass
class Alignment:
    score: int
    matches: int               # words that agree
    start: int                 # first and last + 1 of the aligned words of the query, then of the text
    end: int
    text_start: int
    text_end: int


def align(query: np.ndarray, text: np.ndarray, low: int, high: int) -> Alignment:
    """Smith-Waterman: the best local alignment whose words lie on diagonals (text less query place) ``low`` to ``high``.

    Row by row over the query; a row holds the band only. Large tables keep one row in about the root of their number,
    and the way back from the best cell fills in the rows between two of them as it gets there, so memory is the band
    times twice that root. Gaps in the text run along a row and are resolved by a running maximum. Ties go to the
    earliest end, then to matching over gaps.
    """
    width, m, n = high - low + 1, len(query), len(text)
    along = np.arange(width + 2, dtype=np.int32) * GAP
    stride = 1 if m * width <= SMALL else math.isqrt(m) + 1

    def after(above: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros(width + 2, dtype=np.int32)                # a zero column on each side
        j = i - 1 + low + np.arange(width)                       # place in the text that cell b compares with query i-1
        inside = (j >= 0) & (j < n)
        if not inside.any():
            return row
        same = np.zeros(width, dtype=bool)
        same[inside] = text[j[inside]] == query[i - 1]
        cells = np.maximum(above[1:-1] + np.where(same, MATCH, MISMATCH), above[2:] + GAP)
        row[1:-1] = np.where(inside, np.maximum(cells, 0), 0)
        run = np.maximum.accumulate(row[:-1] - along[:-1]) + along[:-1]
        row[1:-1] = np.where(inside, np.maximum(row[1:-1], run[1:]), 0)
        return row

    row = np.zeros(width + 2, dtype=np.int32)
    h = {0: row}
    best, place = 0, (0, 0)
    for i in range(1, m + 1):
        row = after(row, i)
        if i % stride == 0:
            h[i] = row
        top = int(row.max())
        if top > best:
            best, place = top, (i, int(row.argmax()))
    if not best:
        return Alignment(0, 0, 0, 0, 0, 0)

    def fill(i: int) -> None:
        """Rows ``i - 1`` and ``i`` are there: with a stride, all from the kept row below ``i`` on, and later ones go."""
        if i not in h or i - 1 not in h:
            for k in [k for k in h if k > i or k % stride]:
                del h[k]
            for k in range((i - 1) // stride * stride + 1, i + 1):
                h[k] = after(h[k - 1], k)

    i, b = place
    matches, end, text_end = 0, i, i + low + b - 1
    fill(i)
    while i > 0 and h[i][b] > 0:
        fill(i)
        j = i + low + b - 2
        agree = 0 <= j < n and text[j] == query[i - 1]
        if h[i][b] == h[i - 1][b] + (MATCH if agree else MISMATCH):
            matches += agree
            i -= 1
        elif b + 1 <= width and h[i][b] == h[i - 1][b + 1] + GAP:
            i, b = i - 1, b + 1
        else:
            b -= 1
    return Alignment(best, matches, i, end, i + low + b - 1, text_end)


def bands(diagonals: np.ndarray, slack: int) -> list[tuple[int, int]]:
    """Bands of diagonals: sorted, cut where two neighbours are more than ``slack`` apart, widened by ``slack``."""
    d = np.unique(diagonals)
    cuts = np.flatnonzero(np.diff(d) > slack) + 1
    return [(int(p[0]) - slack, int(p[-1]) + slack) for p in np.split(d, cuts)]
